"""Quotas and backfill against plain loops over generated hits."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from marginalia.operators import allocation

SCHEMA = "q int, item int, chunk int, score double"


def loop(hits, quota, wants, overall, backfill):
    out = []
    for q in sorted({h[0] for h in hits} | {h[0] for h in overall}):
        items = sorted({h[1] for h in hits if h[0] == q})
        ordered = {i: [c for _, c in sorted((-s, c) for a, b, c, s in hits if a == q and b == i)] for i in items}
        used, got = set(), {}
        for i in items:
            got[i] = [c for c in ordered[i] if c not in used][:quota]
            used |= set(got[i])
        places = [(i, got[i][r]) for r in range(quota) for i in items if r < len(got[i])]
        for i in items:
            if (q, i) in wants:
                rest = [c for c in ordered[i] if c not in used]
                used |= set(rest)
                places += [(i, c) for c in rest]
        rest = [c for _, c in sorted((-s, c) for a, c, s in overall if a == q) if c not in used][:backfill]
        out += [(q, i, c, k) for k, (i, c) in enumerate(places + [(None, c) for c in rest], 1)]
    return out


def test_allocation_same_as_a_loop(spark):
    rng = random.Random(6)
    hits = sorted({(q, i, c): (q, i, c, float(rng.randint(0, 30))) for q in range(25) for i in range(rng.randint(1, 7)) for c in rng.choices(range(14), k=rng.randint(0, 12))}.values())
    overall = [(q, c, float(rng.randint(0, 30))) for q in range(27) for c in range(20) if rng.random() < 0.7]
    wants = {(q, i) for q in range(25) for i in range(7) if rng.random() < 0.3}
    rows, order = spark.createDataFrame(hits, SCHEMA), [F.desc("score"), "chunk"]
    args = (rows, spark.createDataFrame(overall, "q int, chunk int, score double"), ["q"], "item", "chunk", order)
    for quota in (1, 3, 50):
        got = allocation.covered(*args, quota=quota, backfill=4, wants_all=spark.createDataFrame(sorted(wants), "q int, item int"))
        assert sorted(map(tuple, got.select("q", "item", "chunk", "place").collect()), key=str) == sorted(loop(hits, quota, wants, overall, 4), key=str)
    got = allocation.allocated(rows, ["q"], "item", "chunk", order, None)
    assert sorted((r["q"], r["item"], r["chunk"]) for r in got.collect()) == sorted((q, min(i for a, i, c2, _ in hits if a == q and c2 == c), c) for q, c in {(h[0], h[2]) for h in hits})
    assert allocation.allocated(rows.limit(0), ["q"], "item", "chunk", order, 2).count() == 0
