"""The stateful operators as streams give what they give in batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.plans.catalog_queries import ALLOWED
from marginalia.streaming import queues


def test_streamed_states_are_the_batch_states(spark, tmp_path):
    rows = [(u, i, s) for u in (1, 2) for i, s in enumerate(["downloading", "ready", "indexing", "ready", "answering"][u - 1 :])]
    where = str(tmp_path / "in")
    spark.createDataFrame(rows, "user_id long, event_id long, to string").coalesce(1).write.parquet(where)
    stream = spark.readStream.schema("user_id long, event_id long, to string").parquet(where)
    q = queues.stream_states(stream, ALLOWED).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["user_id"]: (r["state"], r["accepted"]) for r in spark.table("states").collect()}
    batch = queues.final_states(spark.createDataFrame(rows, "user_id long, event_id long, to string"), "user_id", "event_id", F.col("to"), ALLOWED)
    assert got == {r["user_id"]: (r["state"], r["accepted"]) for r in batch.collect()}
    assert got[1] == ("answering", 4)


def test_streamed_queue_is_the_batch_queue_after_each_batch(spark, tmp_path):
    import datetime
    import random

    rng = random.Random(3)
    start, schema = datetime.datetime(2024, 1, 1), "user_id long, event_id long, ts timestamp, kind string, text string"
    events = [(rng.randint(1, 5), i, start + datetime.timedelta(minutes=rng.randint(0, 1500)), "drain" if rng.random() < 0.06 else "enqueue", rng.choice(["a", None, "b"])) for i in range(300)]
    events += [(9, 1000 + i, start + datetime.timedelta(minutes=1400, seconds=i), "enqueue", "many") for i in range(70)]  # over the limit
    rng.shuffle(events)  # late rows in every batch
    where, told, batches = str(tmp_path / "in"), {}, []

    def keep(rows, _):
        batches.append(1)
        found = rows.collect()
        for user in {r["user_id"] for r in found}:
            told[user] = [(r["place"], r["event_id"], r["at"], r["text"]) for r in found if r["user_id"] == user and r["status"] == "queued"]

    seen = []
    for k in range(4):
        part = events[k::4]
        seen += part
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(where)
        with queues.keyed_state(spark):
            stream = spark.readStream.schema(schema).parquet(where)
            query = queues.stream_queue(stream).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
            query.awaitTermination(300)
        all_so_far = spark.createDataFrame(seen, schema)
        now = all_so_far.agg(F.max("ts")).first()[0]
        batch = queues.waiting(all_so_far, F.lit(now)).withColumn("at", F.unix_micros("ts")).collect()
        oldest = int(all_so_far.agg(F.unix_micros(F.max("ts"))).first()[0]) - 12 * 3_600_000_000
        got = {u: sorted((i[2], i[1], i[3]) for i in items if i[2] >= oldest) for u, items in told.items()}
        want = {}
        for r in batch:
            want.setdefault(r["user_id"], []).append((r["at"], r["event_id"], r["text"]))
        assert {u: i for u, i in got.items() if i} == {u: sorted(i) for u, i in want.items()}
    assert len(batches) >= 4 and len(told[9]) == 50


def test_drained_entries_and_empty_queues(spark, tmp_path):
    import datetime

    at, schema = lambda h: datetime.datetime(2024, 1, 1, h), "user_id long, event_id long, ts timestamp, kind string, text string"
    parts = [[(1, 1, at(1), "enqueue", "x"), (1, 2, at(2), "enqueue", "y"), (2, 3, at(1), "drain", None), (2, 7, at(5), "other", None)], [(1, 4, at(3), "drain", None), (1, 5, at(4), "enqueue", "z")], [(1, 6, at(2), "enqueue", "late")]]
    told = []
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        with queues.keyed_state(spark):
            query = queues.stream_queue(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.foreachBatch(lambda rows, _: told.append(sorted((r["user_id"], r["status"], r["place"], r["text"] or "") for r in rows.collect()))).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
            query.awaitTermination(300)
    assert [t for t in told if t] == [[(1, "queued", 1, "x"), (1, "queued", 2, "y"), (2, "empty", 0, "")], [(1, "drained", 1, "x"), (1, "drained", 2, "y"), (1, "queued", 1, "z")], [(1, "drained", 1, "late"), (1, "queued", 1, "z")]]
