"""marginalia: Spark-native analytics for corpora of structured documents."""
