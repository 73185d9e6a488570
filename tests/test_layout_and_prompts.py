"""Grids from jittered boxes, one-to-one pairs, and shares of a budget, against plain loops."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from marginalia.operators import assignment, layout, prompts


def test_grids_are_rebuilt_from_jittered_boxes(spark):
    rng, boxes, want = random.Random(2), [], {}
    for table in range(12):
        width, height = rng.randint(1, 5), rng.randint(1, 8)
        grid = [[f"h{c}" if r == 0 else rng.choice(["", f"v{r}{c}", f"two words{r}"]) for c in range(width)] for r in range(height)]
        grid = [r for r in grid if any(r)]
        want[table] = grid
        for r, cells in enumerate(grid):
            for c, cell in enumerate(cells):
                left = 200 * c + rng.uniform(0, 30)
                for word in cell.split():
                    top = 40 * r + rng.uniform(-8, 8)
                    boxes.append((table, left, left + 9 * len(word), top, top + rng.uniform(10, 16), word))
                    left += 9 * len(word) + 6
    boxes += [(0, None, 1.0, 0.0, 1.0, "lost"), (0, 1.0, 2.0, 0.0, 1.0, " ")]
    rng.shuffle(boxes)
    got = layout.grid_of_words(spark.createDataFrame(boxes, "table_id int, left double, right double, top double, bottom double, text string"), ["table_id"], line_gap=20, column_gap=20)
    found = {}
    for r in got.orderBy("table_id", "row_idx").collect():
        found.setdefault(r["table_id"], []).append(list(r["cells"]))
    assert found == want


def test_recognised_grids_fill_in(spark):
    schema = "table_id int, row_idx int, cells array<string>"
    own = spark.createDataFrame([(1, 0, ["a", "1"])], schema)
    told = spark.createDataFrame([(1, 0, ["x", "9"]), (2, 0, ["b", "2"]), (2, 1, ["5", "7"]), (3, 0, ["", ""]), (3, 1, ["", "q"])], schema)
    got = layout.with_recognised(own, told).orderBy("table_id", "row_idx").collect()
    assert [(r["table_id"], list(r["cells"]), r["quality"]) for r in got] == [(1, ["a", "1"], ""), (2, ["b", "2"], "high"), (2, ["5", "7"], "high")]


def test_pairs_same_as_taking_the_nearest_first(spark):
    rng = random.Random(7)
    left = [(k, i, rng.choice([None, rng.randint(0, 60)])) for k in range(20) for i in range(rng.randint(0, 9))]
    right = [(k, i, rng.randint(0, 60)) for k in range(22) for i in range(rng.randint(0, 9))]
    want = []
    for k in range(22):
        pairs = sorted((abs(a - b), i, j) for q, i, a in left if q == k and a is not None for q2, j, b in right if q2 == k and abs(a - b) <= 12)
        used_l, used_r = set(), set()
        for d, i, j in pairs:
            if i not in used_l and j not in used_r:
                used_l.add(i)
                used_r.add(j)
                want.append((k, i, j, d))
    got = assignment.nearest_pairs(spark.createDataFrame(left, "k int, left_id int, at int"), spark.createDataFrame(right, "k int, right_id int, at int"), ["k"], 12)
    assert sorted((r["k"], r["left_id"], r["right_id"], r["distance"]) for r in got.collect()) == sorted(want) and len(want) > 20


def loop(facts, budget):
    """Water filling and prefixes, one step at a time."""
    out = []
    for q in sorted({f[0] for f in facts}):
        kinds = sorted({f[1] for f in facts if f[0] == q})
        total = {k: sum(f[3] for f in facts if f[0] == q and f[1] == k) for k in kinds}
        left, share = budget, {}
        for n, k in enumerate(sorted(kinds, key=lambda k: (total[k], k))):
            level = left // (len(kinds) - n)
            if total[k] <= level:
                share[k], left = total[k], left - total[k]
            else:
                share |= {j: max(level, 0) for j in kinds if j not in share}
                break
        took, rest = [], []
        for k in kinds:
            used = 0
            for f in sorted(f for f in facts if f[0] == q and f[1] == k):
                used += f[3]
                (took if used <= share[k] else rest).append(f)
        spent = sum(f[3] for f in took)
        for f in rest:
            spent += f[3]
            if spent > budget:
                break
            took.append(f)
        out += took
    return sorted(out)


def test_shares_same_as_a_loop(spark):
    rng = random.Random(9)
    facts = [(q, f"kind{k}", i, rng.randint(1, 40)) for q in range(30) for k in range(rng.randint(1, 5)) for i in range(rng.randint(1, 9))]
    rows = spark.createDataFrame(facts, "q int, kind string, i int, n int")
    for budget in (0, 50, 200, 100_000):
        got = sorted(map(tuple, prompts.chosen(rows, ["q"], "kind", ["i"], F.col("n"), budget).select("q", "kind", "i", "n").collect()))
        assert got == loop(facts, budget)
        sums = {}
        for q, _, _, n in got:
            sums[q] = sums.get(q, 0) + n
        assert all(s <= budget for s in sums.values())


def test_prompts(spark):
    rows = [(1, "tables", 1, "выручка 1 000,5 руб"), (1, "tables", 2, "x" * 100), (1, "notes", 1, "коротко"), (1, "notes", 2, " "), (2, "notes", 1, "12 %")]
    got = {r["q"]: r["prompt"] for r in prompts.prompt(spark.createDataFrame(rows, "q int, kind string, i int, t string"), ["q"], "kind", ["i"], "t", 60, rules="Отвечай кратко.").collect()}
    assert got == {1: "[Facts]\n[notes]\n- коротко\n[tables]\n- выручка 1000.5 руб\n[Rules]\nОтвечай кратко.", 2: "[Facts]\n[notes]\n- 12%\n[Rules]\nОтвечай кратко."}
