"""Exact search by matrices against plain sums of all pairs, with copies, ties and odd vectors."""

from __future__ import annotations

import functools
import random

import pytest
from pyspark.sql import functions as F

from marginalia.functions import vectors
from marginalia.operators import retrieval as R


def vectors_made():
    rng = random.Random(7)
    some = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(150)]
    near = [[x + 1e-9 * rng.random() for x in some[0]] for _ in range(150)]
    odd = [None, [], [1.0], [None, *some[1][1:]], [0.0] * 8, [float("nan"), *some[2][1:]], [float("nan")] * 8]
    rows = [*some, *near, *[some[3]] * 150, *odd * 2]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("k, sizes", [(5, {}), (5, {"block": 40, "lane": 60}), (900, {"lane": 100})])
def test_same_as_all_pairs(spark, k, sizes):
    """F8, F9, F10, F12: nothing but what can be among the k best leaves a task, and nothing of that is lost."""
    rows = spark.createDataFrame(vectors_made(), "id long, e array<double>").select("id", R.normalised(F.col("e")).alias("v"))
    asked = rows.where("id % 6 = 0").select(F.col("id").alias("q_id"), F.col("v").alias("qv"))
    pairs = rows.join(asked, F.lit(True)).select("q_id", "id", F.round(R.dot(F.col("v"), F.col("qv")), 6).alias("sim"))
    want = R.top(pairs, ["q_id"], [F.desc("sim"), "id"], k).collect()
    got = R.cosine(rows, asked, k, **sizes)
    assert "BroadcastNestedLoopJoin" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, got.collect())) == sorted(map(str, want)) and want


def test_small_steps_in_one_process():
    """The same in this process, where the steps' sizes can be set; sums of pairs in order."""
    import numpy as np
    import pyarrow as pa

    rng, k = np.random.default_rng(3), 7
    v = rng.normal(size=(300, 6))
    v[100:200] = v[5]
    v[200:260] = v[6] + 1e-10 * rng.normal(size=(60, 6))
    v /= np.sqrt((v * v).sum(axis=1))[:, None]
    old = vectors.ROWS, vectors.QUERIES, vectors.PAIRS
    try:
        vectors.ROWS, vectors.QUERIES, vectors.PAIRS = 16, 9, 25
        rows = pa.table({"id": [f"{j:03}" for j in range(300)], "v": pa.array(v.tolist())})
        got = vectors.nearest(rows, pa.table({"q_id": list(range(40)), "qv": pa.array(v[:40].tolist())}), k).to_pylist()
    finally:
        vectors.ROWS, vectors.QUERIES, vectors.PAIRS = old
    for q in range(40):
        sums = [functools.reduce(lambda s, ab: s + ab[0] * ab[1], zip(v[q].tolist(), v[j].tolist(), strict=True), 0.0) for j in range(300)]
        want = sorted((-round(s, 6), f"{j:03}") for j, s in enumerate(sums))[:k]
        own = [r for r in got if r["q_id"] == q]
        assert sorted((-round(r["sim"], 6), r["id"]) for r in own)[:k] == want and len(own) < 100
        assert all(r["sim"] == sums[int(r["id"])] for r in own)
