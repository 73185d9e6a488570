"""Queries over what the engine stores: the persisted index and the chunk store, built from the tables in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.operators.postings import Postings
from marginalia.plans.registry import query, read
from marginalia.plans.retrieval_queries import QUESTIONS, TERMS_SQL
from marginalia.sources import indexing, versions
from marginalia.streaming import queues


@query(f"WITH {TERMS_SQL} SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score, doc_id) AS place FROM bm QUALIFY place <= 20")
def bm25_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents of each question, from an index to which all documents were appended in two batches, one of them twice."""
    docs, index = read(spark, sf_dir, "documents").select("doc_id", "text"), Postings(spark, f"{versions.shared_folder(spark)}/postings")
    for batch in (0, 1, 1):
        index.append(docs.where(F.col("doc_id") % 2 == batch), "documents", batch)
    return index.search(spark.sql(QUESTIONS), 20)


@query("""WITH l AS (SELECT doc_id, source, lang, unnest(string_split(CASE WHEN doc_id % 3 > 0 THEN replace(text, 'e', 'EE') ELSE text END, chr(10))) AS t FROM documents)
SELECT doc_id, source AS owner_id, count(*) AS chunks, CAST(sum(length(t)) AS BIGINT) AS chars, min(CASE WHEN doc_id % 3 > 0 THEN 'second' ELSE lang END) AS role, count(*) * (count(*) + 1) // 2 AS numbers, CAST(sum(length(t)) AS DOUBLE) AS vectors
FROM l WHERE trim(t) <> '' GROUP BY ALL""")
def indexed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stored of each document after a batch of two thirds of them, and one with new texts of two thirds that is sent twice."""
    docs, store = read(spark, sf_dir, "documents"), indexing.ChunkStore(spark, f"{versions.shared_folder(spark)}/chunks", buckets=16)
    for batch, where, text, role in ((0, "doc_id % 3 < 2", F.col("text"), F.col("lang")), (1, "doc_id % 3 > 0", F.replace("text", F.lit("e"), F.lit("EE")), F.lit("second")), (1, "true", F.lit("never"), F.lit("never"))):
        rows = docs.where(where).select("doc_id", F.col("source").alias("owner_id"), F.lit(None).cast("int").alias("page"), F.lit("1 Text").alias("section_path"), F.lit("text").alias("element_type"), F.create_map(F.lit("role"), role).alias("attrs"), F.posexplode(F.split(text, "\n")).alias("ord", "text"))
        store.index(rows, lambda c: F.array(F.length(c).cast("float"), F.lit(1.0).cast("float")), "documents", batch)
    return store.read().groupBy("doc_id", "owner_id").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"), F.min(F.col("attrs")["role"]).alias("role"), F.sum("chunk_no").alias("numbers"), F.sum(F.col("embedding")[0].cast("double")).alias("vectors"))


QUEUE_SQL = """WITH e AS (SELECT *, CASE WHEN event_type = 'purchase' THEN 'drain' ELSE 'enqueue' END AS kind FROM events), n AS (SELECT max(ts) AS now FROM events),
d AS (SELECT user_id, max(ts) AS drained FROM e WHERE kind = 'drain' GROUP BY user_id),
k AS (SELECT e.user_id, event_id, ts FROM e LEFT JOIN d USING (user_id), n WHERE kind = 'enqueue' AND (drained IS NULL OR ts > drained) AND ts >= now - INTERVAL 240 HOUR QUALIFY row_number() OVER (PARTITION BY e.user_id ORDER BY ts DESC, event_id DESC) <= 5)
SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS place FROM k"""


def _queue_events(events: DataFrame) -> DataFrame:
    return events.select("user_id", "event_id", "ts", F.when(F.col("event_type") == "purchase", "drain").otherwise("enqueue").alias("kind"), F.col("event_type").alias("text"))


@query(QUEUE_SQL)
def queue_after_drains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's queue at the last moment of the table, when purchases drain it: at most ten days old, the newest five."""
    events = _queue_events(read(spark, sf_dir, "events"))
    return queues.waiting(events, F.lit(events.agg(F.max("ts")).first()[0]), "240 HOURS", 5).select("user_id", "event_id", "place")


@query(QUEUE_SQL)
def streamed_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream of the table's files in several batches, with keyed state, into a table of the last queue of each user."""
    where = versions.shared_folder(spark)
    events = _queue_events(read(spark, sf_dir, "events"))
    # two files out of the order of time, so that half of the rows come late
    for part in (1, 0):
        events.where(F.col("event_id") % 2 == part).coalesce(1).write.mode("append").parquet(f"{where}/in")
    table = versions.Table(spark, f"{where}/queues", "user_id long, event_id long, at long, text string, status string, place int", ["user_id"], buckets=8)

    def last(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.join(new.select("user_id").distinct(), "user_id", "left_anti").unionByName(new.where("status = 'queued'"))

    with queues.keyed_state(spark):
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
        writer = versions.stream_into(queues.stream_queue(stream, 240 * 3600, 5), table, last, "queues", f"{where}/checkpoint").outputMode("update")
        writer.trigger(availableNow=True).start().awaitTermination()
    now = F.lit(read(spark, sf_dir, "events").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0])
    fresh = table.read().where(F.col("at") >= now - 240 * 3_600_000_000)
    from pyspark.sql import Window

    return fresh.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("at", "event_id")).alias("place"))
