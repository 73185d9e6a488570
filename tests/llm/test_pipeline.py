"""The pipeline: its stages keep the columns, drop what they should and keep the rest."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("kept", F.lit("k")).withColumn("n_lines", F.lit(1)).withColumn("_row", F.lit(2))
    ids, at = {r["doc_id"] for r in docs.select("doc_id").collect()}, docs
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, "")
        at.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        assert at.columns == docs.columns
        sizes.append(at.count())
        assert {r["doc_id"] for r in at.select("doc_id").collect()} <= ids
    assert sizes[0] > 0.97 * len(ids) and sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.8 * len(ids)
    pieces = corpus_pipeline.STAGES[-1][1](spark, at, "")
    assert pieces.select("doc_id").distinct().count() == sizes[-1]


def test_empty_and_odd_rows(spark):
    rows = [(1, None, None, None, None), (1, "", None, None, 0), (None, "x y z", "en", "s", 5), (2, "x y z", "en", "s", 5)]
    for table in (spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, table, "").collect()


def test_pipeline_against_brute_force(spark, tmp_path):
    """After the language stage (whose operator has a held-out test), every stage again in plain Python or other SQL."""
    import duckdb
    import numpy as np
    from tokenizers import Tokenizer

    import public_tokenizers
    from marginalia.llm import langid, line_dedup
    from test_operators import classes

    folder = tmp_path / "sf"
    folder.mkdir()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.toPandas().to_parquet(str(folder / "documents.parquet"))
    spoken = {r["doc_id"] for r in langid.identify(docs).where("kept").collect()}
    db = duckdb.connect()
    db.sql(f"CREATE TABLE every AS SELECT * FROM '{folder}/documents.parquet'")
    db.register("ids", __import__("pandas").DataFrame({"doc_id": sorted(spoken)}))
    db.sql("CREATE VIEW documents AS SELECT * FROM every SEMI JOIN ids USING (doc_id)")
    rows = [(i, t) for i, t, gone in db.sql(f"SELECT doc_id, text, emptied FROM ({line_dedup.SQL})").fetchall() if not gone]
    first = classes(rows)
    rows = {i: t for i, t in rows if first[i] == i}
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {}
    for p in corpus_pipeline.run(spark, str(folder)).collect():
        got.setdefault(p["doc_id"], []).append((p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]))
    assert set(got) == set(rows)
    for i, text in rows.items():
        ids, end = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for start, length, crc, total in sorted(got[i]):
            assert start == end and total == len(ids) and crc == __import__("zlib").crc32(ids[start : start + length].tobytes())
            end += length
        assert end == len(ids)


def test_rows_that_share_a_doc_id(spark):
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(1, long), (1, "quite another text of its own here"), (1, long), (2, long + " end"), (None, long), (None, "a text of no number at all here"), (3, None), (3, None), (None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("x"))
    got = sorted((str(r["doc_id"]), str(r["text"])[:13]) for r in corpus_pipeline.near_copies(spark, table, "").collect())
    assert got == sorted([("1", long[:13]), ("1", "quite another"), ("3", "None"), ("None", "a text of no "), ("None", "None")])
