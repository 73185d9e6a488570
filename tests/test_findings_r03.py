"""Small cases of round 3's findings; each failed before, but that of F5, which the old code passed too."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from marginalia.functions import questions
from marginalia.operators import charts, postings, tables
from marginalia.plans.catalog_queries import upsert_figures
from marginalia.plans.text_queries import chart_points
from marginalia.sources import versions
from marginalia.streaming import queues


def test_what_is_cut_is_read_by_columns_and_compressed(spark):
    """F1, F13, F16, F18, F19, F20, F22, F23."""
    df = spark.range(20_000).select("id", F.lit("Состав заказа дан в таблице " * 8).alias("text"))
    held = versions.cut(df)
    plan = held.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "text" not in plan.split("ReadSchema")[1]
    assert held.count() == 20_000 and held.schema == df.schema or held.columns == df.columns


def test_points_pair_their_own_values(spark):
    """a point without a value takes none of the next one; entities, self-closing points and number references are read."""
    ser = lambda x: f"<c:ser><c:tx><c:v>a &lt; b</c:v></c:tx><c:cat>{x}</c:cat><c:val><c:pt idx='0'><c:v>1</c:v></c:pt><c:pt idx='1'/><c:pt idx='2'><c:v>3</c:v></c:pt></c:val></c:ser>"
    parts = {1: '<c:pt idx="0"></c:pt><c:pt idx="2"><c:v>R&amp;D</c:v></c:pt>', 2: '<c:pt idx="2"><c:v>R&#38;D</c:v></c:pt>'}
    rows = [(k, f'<c:chart xmlns:c="x">{ser(x)}</c:chart>') for k, x in parts.items()]
    got = charts.points(spark.createDataFrame(rows, "chart_id int, xml string")).orderBy("chart_id", "pt_idx").collect()
    assert [(r["chart_id"], r["series"], r["pt_idx"], r["category"], r["value"]) for r in got] == [(k, "a < b", i, c, v) for k in (1, 2) for i, c, v in ((0, None, 1.0), (1, None, None), (2, "R&D", 3.0))]


def test_lines_of_one_number_count_by_their_place(spark, tmp_path):
    """F3."""
    rows = [(1, "F", 1, 100 + k, float(k)) for k in range(40)]
    spark.createDataFrame(rows, "l_orderkey long, l_linestatus string, l_linenumber int, l_partkey long, l_quantity double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert [(r["category"], r["value"]) for r in chart_points(spark, str(tmp_path)).where("pt_idx = 1").collect()] == [("100", 0.0)]
    plan = chart_points(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "row_index" in plan and "any_value" not in plan


@pytest.mark.parametrize("value", [0.05, 0.05 + 7e-18 * 3, 0.1 - 0.05 + 2e-17, sum([0.01] * 5)])
def test_a_whole_number_does_not_hang_on_noise(spark, value):
    """F4."""
    said = spark.range(1).select(charts.bullet(F.lit("x"), F.lit(value) + F.lit(1e-16), F.lit(""), F.lit(False)).alias("s")).first()["s"]
    assert said == "— x: 0"


def test_one_batch_tells_a_queue_once(spark, tmp_path):
    """rows and a time limit in one batch."""
    at, schema = lambda h: datetime.datetime(2024, 1, 1, h), "user_id long, event_id long, ts timestamp, kind string, text string"
    parts = [[(1, 1, at(1), "enqueue", "old"), (1, 2, at(9), "enqueue", "y")], [(1, 3, at(9), "enqueue", "z")], [(2, 4, at(15), "enqueue", "w")], [(1, 5, at(14), "enqueue", "v"), (2, 6, at(15), "enqueue", "u")]]
    told = []
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        with queues.keyed_state(spark):
            query = queues.stream_queue(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 4 * 3600, 5).writeStream.foreachBatch(lambda rows, _: told.append([(r["user_id"], r["event_id"]) for r in rows.where("status = 'queued'").collect()])).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
            query.awaitTermination(300)
    assert all(len(t) == len(set(t)) for t in told)
    assert not any((1, 1) in t for t in told[1:])


def test_figures_are_found_when_stages_are_made_again(spark, tmp_path):
    """row numbers hold however partitions are read."""
    rows = [(k, k % 50, f"p{k}", f"b{k}") for k in range(1, 60_001)]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_name string, p_brand string").repartition(16).write.parquet(str(tmp_path / "part.parquet"))
    got = upsert_figures(spark, str(tmp_path))
    assert "monotonically" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.count() == sum(k % 4 > 0 or k % 2 == 0 for k, *_ in rows)
    wrong = got.withColumn("k", F.substring("image", 4, 9).cast("long")).where("k % 2 = 0 AND k % 5 > 0 AND caption <> concat('b', k)")
    assert wrong.count() == 0


def test_cardinals_are_no_ordinals(spark):
    """F7."""
    t = F.lit("в пятью главе, в пятой главе, двадцати")
    assert spark.range(1).select(questions.with_digits(t, cardinals=False)).first()[0] == "в пятью главе, в 5 главе, двадцати"
    assert spark.range(1).select(questions.with_digits(t)).first()[0] == "в 5 главе, в 5 главе, 20"


def test_ranges_of_an_index_grow_with_its_words(spark, tmp_path, monkeypatch):
    """a task counts and sorts so many words, however many there are."""
    monkeypatch.setattr(postings, "RANGE", 500)
    index = postings.Postings(spark, str(tmp_path / "index"))
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("von der"), *[F.concat(F.lit(f"w{k}x"), (F.col("id") % 7).cast("string")) for k in range(98)]).alias("text"))
    index.append(docs)
    parts = index.rows().groupBy(F.spark_partition_id(), F.input_file_name()).count().collect()
    assert len(parts) >= 10 and max(r["count"] for r in parts) < 1500 and sum(r["count"] for r in parts) == 6000


def test_tasks_of_cells_grow_with_the_rows(spark, monkeypatch):
    """a task sorts so many rows, however many there are; what is by table after that stays where it lies."""
    monkeypatch.setattr(tables, "ROWS", 100)
    rows = spark.range(3000).select((F.col("id") % 500).alias("t"), "id", F.col("id").cast("double").alias("v"))
    cells = tables.melt(rows, ["t"], ["id"], ["v", "id"])
    assert cells.count() == 6000 and cells.where("col_idx = 0").agg(F.max("row_idx")).first()[0] == 6
    assert "REPARTITION_BY_NUM" in cells._jdf.queryExecution().executedPlan().toString()
    assert cells.select(F.spark_partition_id()).distinct().count() > 20
