"""Periodic runs against all stretches of small texts, and the query against plain loops."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from marginalia.llm import periodic, queries

DOCS = "doc_id long, text string, runs int, n_words string, start long"


def brute(words, least=12):
    """Every period, every maximal stretch; the smallest period of a stretch counts."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def numbers(words):
    known = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64)


def texts(rng, k):
    """Words of few kinds, repeated stretches, nested repeats, broken repeats."""
    kind = k % 6
    if kind == 0:
        return [rng.choice("ab") for _ in range(rng.randint(0, 60))]
    if kind == 1:
        return [rng.choice("abcdefgh") for _ in range(rng.randint(0, 40))] + [rng.choice("abc") for _ in range(rng.randint(1, 9))] * rng.randint(1, 9) + [rng.choice("abc") for _ in range(rng.randint(0, 9))]
    if kind == 2:
        unit = ["x"] * rng.randint(1, 15) + ["y"] * rng.randint(0, 3)
        return (unit * rng.randint(1, 8))[: rng.randint(1, 120)]
    if kind == 3:
        inner = [rng.choice("ab") for _ in range(rng.randint(1, 4))] * rng.randint(1, 7)
        return (inner + [rng.choice("abz")]) * rng.randint(1, 6)
    if kind == 4:
        base = [f"w{i}" for i in range(rng.randint(1, 40))] * rng.randint(2, 5)
        for _ in range(rng.randint(0, 3)):
            base[rng.randrange(len(base))] = "broken"
        return base
    return ["z"] * rng.randint(0, 70)


@pytest.mark.parametrize("least", [12, 2])
def test_runs_same_as_brute_force(least):
    rng = random.Random(5)
    for k in range(3000):
        words = texts(rng, k)
        assert periodic.runs_of(numbers(words), least) == brute(words, least), words


def test_every_period_is_found():
    for q in range(1, 130):
        words = ["before"] + [f"w{i}" for i in range(q)] * 2 + [f"w{i}" for i in range(q // 2)] + ["behind"]
        want = brute(words)
        assert periodic.runs_of(numbers(words)) == want and (len(words) < 14 or len(want) == 1)


def test_long_texts_take_time_in_proportion():
    import time

    began = time.time()
    assert periodic.runs_of(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    assert periodic.runs_of(np.arange(300_000)) == []
    unit = np.arange(75_000)
    assert periodic.runs_of(np.concatenate([unit, unit, unit, unit])) == [(0, 300_000, 75_000)]
    assert periodic.runs_of(np.tile([0, 1, 2, 3, 4, 5, 6], 43_000)) == [(0, 301_000, 7)]
    assert time.time() - began < 60


def edited(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def row(doc_id, text, runs):
    words = edited(doc_id, text)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = queries.op13_periodic_runs(spark, "/root/testdata/sf0.001")
    assert got.columns == COLUMNS
    want = []
    for r in docs:
        words = edited(r["doc_id"], r["text"])
        want.append(row(r["doc_id"], r["text"], brute(numbers(words).tolist())))
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == sorted(want) and sum(r[1] > 0 for r in rows) > 10


def test_edge_rows(spark):
    chosen = [i for i in range(200, 400) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a b " * 10), (4, "a b " * 10), (None, "c " * 12), (5, "a b\x1c c " * 14), (6, "one two\x0bthree"), (7, "日本 語 " * 6), (-8, "x" * 70_000), (9, "wort " * 50_000)]
    rows += [(i, " ".join(f"w{k}" for k in range(50))) for i in chosen] + [(chosen[0], " "), (chosen[1], "one")]
    table = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], DOCS)
    got = periodic.described(periodic.collapse(periodic.planted(table)))
    assert got.columns == COLUMNS
    want = [row(i, t, brute(edited(i, t)) if i != 9 else [(0, 50_000, 1)]) for i, t in rows]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert periodic.described(periodic.collapse(periodic.planted(spark.createDataFrame([], DOCS)))).count() == 0
    texts_of = {r["doc_id"]: r["text"] for r in periodic.collapse(table).collect()}
    assert texts_of[4] == "a b" and texts_of[1] == "" and texts_of[6] == "one two three"
