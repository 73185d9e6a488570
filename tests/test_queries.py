"""Every query with SQL gives the rows of its SQL in another engine, over whole tables."""

from __future__ import annotations

import math
from pathlib import Path

import pytest

from marginalia import catalogue

DATA = Path("/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def other():
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for f in sorted(DATA.glob("*.parquet")):
        db.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return db


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows_as_sql(spark, other, name):
    ours = catalogue.QUERIES[name](spark, str(DATA))
    theirs = other.sql(catalogue.ORACLE_SQL[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours.columns, ours.collect()) == rows_of(theirs.columns, theirs.fetchall())


def test_queries_without_sql_against_python(spark):
    import difflib

    from marginalia.functions.texts import cut_points

    assert set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) == {"cut_for_messages", "fuzzy_captions"}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(DATA / "documents.parquet")).collect()}
    got = catalogue.QUERIES["cut_for_messages"](spark, str(DATA)).collect()
    for doc, text in docs.items():
        pieces = [p for _, p in sorted((r["piece_no"], r["piece"]) for r in got if r["doc_id"] == doc)]
        assert pieces == cut_points(text, 3500) and all(len(p) <= 3500 for p in pieces)
        assert "".join("".join(pieces).split()) == "".join(text.split())
    names = sorted({r["p_name"] for r in spark.read.parquet(str(DATA / "part.parquet")).collect()})
    for typed in ("lavender part", "Azure"):
        want = sorted((-round(difflib.SequenceMatcher(None, typed.lower(), n.lower()).ratio(), 6), n) for n in names)[:3]
        own = sorted((r["place"], r["p_name"], r["ratio"]) for r in catalogue.QUERIES["fuzzy_captions"](spark, str(DATA)).collect() if r["typed"] == typed)
        assert [(-r, n) for _, n, r in own] == want
