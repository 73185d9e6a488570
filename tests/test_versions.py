"""Tables behind pointers, streams into them, and the persisted index."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from marginalia.operators import retrieval
from marginalia.operators.postings import Postings
from marginalia.sources import catalog, versions

SCHEMA = "id long, name string, n int"


def upsert(old, new):
    return catalog.upsert(old, new, ["id"], "at")


def rows(table, version=None):
    return sorted(map(tuple, table.read(version).collect()))


@pytest.fixture
def table(spark, tmp_path):
    return versions.Table(spark, str(tmp_path / "t"), SCHEMA, ["id"], buckets=4)


def batch(spark, *values):
    return spark.createDataFrame([(i, name, n, k) for k, (i, name, n) in enumerate(values)], "id long, name string, n int, at int")


def test_upserts_replays_and_versions(spark, table):
    assert rows(table) == [] and table.version() == 0
    assert table.apply(batch(spark, (1, "a", 1), (2, "b", 2), (1, "c", None)), upsert, "w", 0) == 1
    assert rows(table) == [(1, "c", None), (2, "b", 2)]
    again = batch(spark, (2, "z", None), (3, "d", 3), (None, "none", 0))
    assert table.apply(again, upsert, "w", 1) == 2 and table.apply(again, upsert, "w", 1) == 2  # a replay
    assert table.apply(batch(spark, (9, "old", 9)), upsert, "w", 0) == 2
    assert sorted(map(str, table.read().collect())) == sorted(map(str, spark.createDataFrame([(1, "c", None), (2, "z", 2), (3, "d", 3), (None, "none", 0)], SCHEMA).collect()))
    assert rows(table, 1) == [(1, "c", None), (2, "b", 2)]
    table.apply(batch(spark), upsert, "w", 2)  # an empty batch counts
    assert table.version() == 3 and table.read().count() == 4


def test_only_touched_buckets_are_written(spark, table):
    table.apply(batch(spark, *[(i, "x", i) for i in range(50)]), upsert)
    before = table.pointers.last()[1]["folders"]
    table.apply(batch(spark, (7, "y", 0)), upsert)
    after = table.pointers.last()[1]["folders"]
    assert sum(before[b] != after[b] for b in before) == 1 and table.read().count() == 50


def test_deleted_rows_and_forgotten_versions(spark, table, tmp_path):
    table.apply(batch(spark, (1, "a", 1), (2, "b", 2)), upsert)
    table.apply(batch(spark, (1, "", 0)), lambda old, new: old.join(new.select("id"), "id", "left_anti"))
    assert rows(table) == [(2, "b", 2)]
    table.apply(batch(spark, (1, "again", 1)), upsert)
    table.forget(keep=1)
    assert rows(table) == [(1, "again", 1), (2, "b", 2)]
    held = {f for f in table.pointers.last()[1]["folders"].values() if f}
    assert {p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("data-")} == held


def test_a_change_that_dies_before_its_pointer(spark, table, monkeypatch):
    table.apply(batch(spark, (1, "a", 1)), upsert, "w", 0)
    with monkeypatch.context() as m:
        m.setattr(versions, "put_once", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            table.apply(batch(spark, (1, "b", 2)), upsert, "w", 1)
    assert rows(table) == [(1, "a", 1)]
    table.apply(batch(spark, (1, "b", 2)), upsert, "w", 1)
    assert rows(table) == [(1, "b", 2)]


def test_of_two_changes_at_once_none_is_lost(spark, table, monkeypatch):
    table.apply(batch(spark, (1, "a", 1)), upsert)
    real, between = versions.put_once, [True]

    def late(*a):
        if between:
            between.clear()
            table.apply(batch(spark, (1, "other", None), (2, "other", 5)), upsert)
        return real(*a)

    monkeypatch.setattr(versions, "put_once", late)
    assert table.apply(batch(spark, (1, None, 7)), upsert) == 3
    assert rows(table) == [(1, "other", 7), (2, "other", 5)]


def test_many_writers_at_once(spark, table):
    work = [threading.Thread(target=lambda k=k: table.apply(batch(spark, (k, f"w{k}", k)), upsert, f"w{k}", 0)) for k in range(4)]
    [t.start() for t in work]
    [t.join() for t in work]
    assert rows(table) == [(k, f"w{k}", k) for k in range(4)] and table.version() == 4


def test_a_stream_into_a_table(spark, table, tmp_path):
    where = str(tmp_path / "in")
    schema = "id long, name string, n int, at int"
    for part in ([(1, "a", 1), (2, "b", 2)], [(2, "c", None), (3, "d", 3)]):
        batch(spark, *part).coalesce(1).write.mode("append").parquet(where)
        stream = spark.readStream.schema(schema).parquet(where)
        query = versions.stream_into(stream, table, upsert, "s", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert rows(table) == [(1, "a", 1), (2, "c", 2), (3, "d", 3)]
    version = table.version()
    # the stream begins anew and sends the batches under the same numbers: nothing changes
    query = versions.stream_into(spark.readStream.schema(schema).parquet(where), table, upsert, "s", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert table.version() == version and rows(table) == [(1, "a", 1), (2, "c", 2), (3, "d", 3)]


def test_cached_by_two_writers(spark, tmp_path):
    made = []
    make = lambda: made.append(1) or spark.range(len(made))
    work = [threading.Thread(target=lambda: versions.cached(spark, str(tmp_path), "k", 1, make)) for _ in range(3)]
    [t.start() for t in work]
    [t.join() for t in work]
    first = versions.cached(spark, str(tmp_path), "k", 1, make).count()
    assert versions.cached(spark, str(tmp_path), "k", 1, make).count() == first and len(list((tmp_path / "k.v1" / "_versions").iterdir())) <= 2


DATA = "/root/testdata/sf0.01"
ASKED = [(1, "the thing of inan"), (2, "que les réau"), (3, "License version 2.0"), (4, "zzzznothing"), (5, ""), (6, "de la ciones 3 de DE")]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    from marginalia.operators import postings

    postings.ROW_GROUP = 1 << 16  # many row groups in small files
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    made = Postings(spark, str(tmp_path_factory.mktemp("index")))
    for k in range(3):
        assert made.append(docs.where(F.col("doc_id") % 3 == k), "w", k) == k + 1
    assert made.append(docs.where("doc_id % 3 = 2"), "w", 2) == 3  # a replay
    return made


def test_index_equals_a_scan(spark, index):
    docs, asked = spark.read.parquet(f"{DATA}/documents.parquet"), spark.createDataFrame(ASKED, "q_id int, query string")
    want = sorted(map(tuple, retrieval.bm25(docs, asked, 10).collect()))
    assert sorted(map(tuple, index.search(asked, 10).collect())) == want and len({r[0] for r in want}) == 4
    only = docs.where("doc_id % 7 = 0")
    some = index.search(asked, 10, only=only).collect()
    scores = {(r[0], r[1]): r[2] for r in retrieval.bm25(docs, asked, 100_000).collect()}
    assert some and all(r["doc_id"] % 7 == 0 and r["score"] == scores[r["q_id"], r["doc_id"]] for r in some)


def test_search_reads_its_words_row_groups(spark, index):
    asked = spark.createDataFrame([(1, "inan")], "q_id int, query string")
    found = index.search(asked, 5)
    plan = found._jdf.queryExecution().toString()
    assert "StringStartsWith(word,inan)" in plan
    # what is pushed down leaves out nearly all row groups: each holds a range of words
    import pyarrow.parquet as pq

    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.rows().inputFiles()]
    ranges = [m.row_group(k).column(0).statistics for m in groups for k in range(m.num_row_groups)]
    assert len(ranges) > 20 and all(r.has_min_max for r in ranges)
    assert sum(r.max >= "inan" and r.min < "inao" for r in ranges) < len(ranges) / 4


def test_more_terms_than_ranges(spark, index, monkeypatch):
    from marginalia.operators import postings

    asked = spark.createDataFrame(ASKED, "q_id int, query string")
    before = sorted(map(tuple, index.search(asked, 10).collect()))
    monkeypatch.setattr(postings, "MOST_RANGES", 1)
    assert sorted(map(tuple, index.search(asked, 10).collect())) == before


def test_merged_segments_and_an_empty_index(spark, tmp_path):
    made = Postings(spark, str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, "one two")], "q_id int, query string")
    assert made.search(asked, 3).count() == 0 and made.merge() == 0
    docs = [(1, "one two three"), (2, "two"), (3, None), (4, ""), (5, "twofold one")]
    for k in (0, 1):
        made.append(spark.createDataFrame(docs[k::2], "doc_id long, text string"))
    before = sorted(map(tuple, made.search(asked, 5).collect()))
    assert made.merge() == 3 and len(made.pointers.last()[1]["segments"]) == 1
    assert sorted(map(tuple, made.search(asked, 5).collect())) == before and [r[1] for r in before] == [1, 5, 2] or len(before) == 3


def test_session_folder_is_there(spark):
    where = versions.shared_folder(spark)
    spark.range(3).write.parquet(f"{where}/x")
    assert spark.read.parquet(f"{where}/x").count() == 3


def test_nothing_is_left_when_the_session_has_ended(tmp_path):
    import os
    import subprocess
    import sys
    import time
    from pathlib import Path

    where, home = tmp_path / "shared", str(Path(__file__).resolve().parent.parent)
    where.mkdir()
    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{where}").getOrCreate()
from marginalia.sources import versions
versions.cut(spark.range(5)).write.parquet(versions.shared_folder(spark) + "/x")
import os
assert os.listdir("{where}")
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=home, env=os.environ | {"PYTHONPATH": home}, capture_output=True, text=True, timeout=180)
    assert done.returncode == 0, done.stderr[-2000:]
    for _ in range(100):  # the JVM ends a moment after Python
        if not os.listdir(where):
            break
        time.sleep(0.2)
    assert os.listdir(where) == []
