"""Whitening against exact fractions, with large offsets, scales and odd rows."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest
from marginalia.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<double>, n int, deviation string, key int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA)


def exact(vectors):
    """n, S, and V as fractions, centred before multiplying."""
    x = [[int(np.floor(64 * Fraction(c))) + 1_000_000 if abs(c) < 1e15 else 64 * int(c) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    z = [[Fraction(n * r[i] - s[i], n) for i in range(d)] for r in x]
    v = [[sum(r[i] * r[j] for r in z) / n for j in range(d)] for i in range(d)]
    return x, n, s, v


def check(got, vectors, most=32):
    x, n, s, v = exact(list(vectors.values()))
    vf = np.array([[float(c) for c in row] for row in v])
    e, q = np.linalg.eigh(vf)
    e, q = e[::-1], q[:, ::-1]
    held = min(most, int(np.linalg.matrix_rank(vf)))
    z = np.array([[float(Fraction(n * c - t, n)) for c, t in zip(r, s, strict=True)] for r in x])
    assert len(got) == len(vectors) * held
    table = {(r["vec_id"], r["component"]): r for r in got}
    for k in range(held):
        want = z @ q[:, k] / np.sqrt(e[k])
        have = np.array([table[i, k + 1]["whitened"] for i in vectors])
        sign = np.sign(want @ have)
        assert np.abs(have * sign - want).max() < 1e-6
        assert abs(table[next(iter(vectors)), k + 1]["explained"] / (e[k] / np.trace(vf)) - 1) < 1e-6
    for i, r in zip(vectors, x, strict=True):
        assert table[i, 1]["deviation"] == sum((n * c - t) ** 2 for c, t in zip(r, s, strict=True)) and table[i, 1]["n"] == n
    errors = {r["identity_error"] for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-6


def test_products_of_integers_are_exact():
    rng = np.random.default_rng(1)
    for high in (5, 1 << 19, 1 << 40, 1 << 61):
        a, b = rng.integers(-high, high, (9000, 3)), rng.integers(-high, high, (9000, 4))
        total = whitening.ExactSum(3, 4)
        total.add(a, b)
        assert (total.value() == a.astype(object).T.dot(b.astype(object))).all()
    big = np.array([[10**40, -3], [7, -(10**35)]], dtype=object)
    assert (whitening.exact_product(big, big) == big.dot(big)).all()


def test_rank_of_integer_matrices():
    a = np.array([[1, 2, 3], [2, 4, 6], [0, 1, 10**30]], dtype=object)
    assert whitening.rank(a) == 2 and whitening.rank(a * 0) == 0 and whitening.rank(np.eye(4, dtype=int).astype(object)) == 4


def test_same_as_fractions(spark):
    rng = np.random.default_rng(2)
    turn = rng.normal(size=(6, 6))
    vectors = {i: (rng.normal(size=6) @ turn * 3).tolist() for i in range(60)}
    for parts in (1, 7):
        check(whitening.whiten(frame(spark, vectors.items()).repartition(parts)).collect(), vectors)


def test_large_offsets_and_uneven_scales(spark):
    rng = np.random.default_rng(3)
    vectors = {i: (rng.normal(size=5) * [1e9, 1e5, 1, 1, 0.1] + [1e13, -1e12, 1e6, 0, 3]).tolist() for i in range(80)}
    got = whitening.whiten(frame(spark, vectors.items())).collect()
    x, n, s, v = exact(list(vectors.values()))
    assert len(got) == 80 * 5 and got[0]["identity_error"] < 1e-4
    # the smallest eigenvalue by inverse iteration in fractions of the exact covariance
    total = sum(v[i][i] for i in range(5))
    low = np.array([Fraction(1)] * 5, dtype=object)
    for _ in range(12):
        m = [list(row) + [c] for row, c in zip(v, low, strict=True)]
        for i in range(5):
            m[i] = [c / m[i][i] for c in m[i]]
            for j in range(5):
                if j != i:
                    m[j] = [a - m[j][i] * b for a, b in zip(m[j], m[i], strict=True)]
        low = np.array([r[-1] for r in m], dtype=object)
        top = max(low, key=abs)
        low = np.array([Fraction(float(c / top)) for c in low], dtype=object)
    value = sum(low[i] * v[i][j] * low[j] for i in range(5) for j in range(5)) / sum(c * c for c in low)
    have = {r["explained"] for r in got if r["component"] == 5}.pop()
    assert abs(have / float(value / total) - 1) < 1e-4


def test_rows_that_take_no_part_and_repeated_rows(spark):
    rng = np.random.default_rng(4)
    vectors = {i: rng.normal(size=3).tolist() for i in range(20)}
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 0.0]), (103, [float("inf"), 0.0, 0.0]), (104, []), (105, [1.0, 2.0]), (106, [0.0] * 7)]
    check(whitening.whiten(frame(spark, [*vectors.items(), *odd])).collect(), vectors)
    twice = whitening.whiten(frame(spark, [*vectors.items(), (0, vectors[0]), (None, vectors[1])])).collect()
    assert {r["n"] for r in twice} == {22} and sum(r["vec_id"] == 0 for r in twice) == 6 and sum(r["vec_id"] is None for r in twice) == 3


def test_rank_ends_the_components_and_empty_tables(spark):
    vectors = {i: [float(i), 2.0 * i, 5.0] for i in range(10)}  # one dimension only
    check(whitening.whiten(frame(spark, vectors.items())).collect(), vectors)
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(frame(spark, [(i, [3.0, 4.0]) for i in range(5)])).count() == 0
    assert whitening.whiten(frame(spark, [])).count() == 0 and whitening.whiten(frame(spark, [(1, None)])).count() == 0


def test_entries_beyond_long_integers(spark):
    vectors = {0: [1e30, 1.0], 1: [-1e30, 2.0], 2: [3e30, 7.0], 3: [0.0, -4.0]}
    got = whitening.whiten(frame(spark, vectors.items())).collect()
    assert len(got) == 8 and all(r["deviation"] is None for r in got)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_query_on_the_table(spark, folder):
    where = f"/root/testdata/{folder}"
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{where}/embeddings.parquet").collect()}
    got = queries.op12_whitening(spark, where).toPandas()
    x = np.floor(64 * np.array(list(vectors.values()), np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    z = n * x - s
    v = (z.T @ z) / n**3
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    assert len(got) == n * 32 and got["identity_error"].iloc[0] < 1e-9
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[list(vectors)].to_numpy()
    want = (z / n) @ q[:, :32] / np.sqrt(e[:32])
    assert np.abs(np.abs(wide) - np.abs(want)).max() < 1e-6
    one = got[got["component"] == 1].set_index("vec_id")
    assert (one.loc[list(vectors), "deviation"].to_numpy() == (z.astype(object) ** 2).sum(1)).all()
    assert np.allclose(got.groupby("component")["explained"].first(), e[:32] / np.trace(v), rtol=1e-9)
