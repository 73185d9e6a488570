"""A persisted inverted index for BM25: what a search reads are the row groups of its words."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.operators import retrieval
from marginalia.sources import versions

#: Terms up to which a search is put to the files as ranges of words; more are joined with all postings.
MOST_RANGES = 400
#: Bytes of a row group: small, so that a range of words reads little beside it.
ROW_GROUP = 4 << 20
#: Words of a range that one task counts and sorts, so that its memory does not grow with the documents.
RANGE = 1_000_000
SCHEMA = "word string, doc_id long, tf long, dl int"


class Postings:
    """Segments of postings (word, doc_id, tf and the document's length), each sorted by word over all its files.

    Documents are appended in segments; a search reads all of them as one. A document must be in one
    segment only.
    """

    def __init__(self, spark: SparkSession, where: str):
        self.spark, self.pointers = spark, versions.Pointers(spark, where)

    def append(self, docs: DataFrame, writer: str | None = None, batch: int | None = None) -> int:
        """Adds a segment of documents (doc_id, text) and returns the version; a writer's batch that was added before changes nothing.

        Words are dealt once, by ranges of (word, doc_id), so that a frequent word takes several files,
        and counted where they lie.
        """

        def make(state: dict) -> dict | None:
            if writer is not None and batch is not None and batch <= state.get("writers", {}).get(writer, -1):
                return None
            tokens = retrieval.spread(docs.select("doc_id", "text")).select("doc_id", retrieval.words(F.col("text")).alias("w"))
            n, total = tokens.agg(F.count("*"), F.coalesce(F.sum(F.greatest(F.size("w"), F.lit(0))), F.lit(0))).first()
            counted = tokens.select("doc_id", F.size("w").alias("dl"), F.explode("w").alias("word")).repartitionByRange(self.ranges(total), "word", "doc_id").groupBy("word", "doc_id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
            folder = f"seg-{uuid.uuid4().hex}"
            counted.select("word", F.col("doc_id").cast("long").alias("doc_id"), "tf", "dl").sortWithinPartitions("word", "doc_id").write.option("parquet.block.size", ROW_GROUP).parquet(f"{self.pointers.where}/{folder}")
            writers = state.get("writers", {}) | ({writer: batch} if writer is not None else {})
            return {"segments": [*state.get("segments", []), {"folder": folder, "n": n, "total": total}], "writers": writers}

        return self.pointers.change(make)

    def ranges(self, total: int) -> int:
        """Into how many ranges so many words are dealt: one for each core, more where they would exceed RANGE."""
        return max(self.spark.sparkContext.defaultParallelism, -(-total // RANGE))

    def merge(self) -> int:
        """Makes one segment of all, still sorted; what is found stays the same."""

        def make(state: dict) -> dict | None:
            if len(state.get("segments", [])) < 2:
                return None
            folder, parts = f"seg-{uuid.uuid4().hex}", state["segments"]
            self.rows(state).repartitionByRange(self.ranges(sum(s["total"] for s in parts)), "word", "doc_id").sortWithinPartitions("word", "doc_id").write.option("parquet.block.size", ROW_GROUP).parquet(f"{self.pointers.where}/{folder}")
            return state | {"segments": [{"folder": folder, "n": sum(s["n"] for s in parts), "total": sum(s["total"] for s in parts)}]}

        return self.pointers.change(make)

    def rows(self, state: dict | None = None) -> DataFrame:
        """All postings."""
        state = self.pointers.last()[1] if state is None else state
        paths = [f"{self.pointers.where}/{s['folder']}" for s in state.get("segments", [])]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def hits(self, terms: DataFrame) -> DataFrame:
        """q_id, term, doc_id, dl and tf of the terms (q_id, term), each for all words that begin with it."""
        found, known = self.rows(), [r["term"] for r in terms.select("term").distinct().limit(MOST_RANGES + 1).collect()]
        least = terms.agg(F.min(F.length("term"))).first()[0] or 1
        heads = terms.withColumn("head", F.substring("term", 1, least))
        if len(known) <= MOST_RANGES:  # a term of at least one letter each, and of one query at most ten
            found = found.where(reduce(lambda a, b: a | b, [F.startswith("word", F.lit(t)) for t in known], F.lit(False)))
        met = found.withColumn("head", F.substring("word", 1, least)).join(heads, "head").where(F.startswith("word", "term"))
        return met.groupBy("q_id", "term", "doc_id", "dl").agg(F.sum("tf").alias("tf"))

    def search(self, queries: DataFrame, k: int, only: DataFrame | None = None) -> DataFrame:
        """q_id, doc_id, score, place as retrieval.bm25 gives them over all segments; only: documents (doc_id) that may be found, the words' weights are those of all."""
        segments = self.pointers.last()[1].get("segments", [])
        n, total = sum(s["n"] for s in segments), sum(s["total"] for s in segments)
        return retrieval.ranked(self.hits(retrieval.terms_of(queries)), n, total / n if n else 1.0, k, only)
