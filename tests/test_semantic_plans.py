"""Spans against a loop of Python's own matches, and plans of questions with nested and overlapping names."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from marginalia.functions import semantic_plans, spans


def test_spans_same_as_a_loop(spark):
    patterns = {"a": r"ab+", "b": r"b+c?", "c": r"abc|ca", "d": r"\bca\b"}
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 30))) for _ in range(400)] + [None]

    def loop(text):
        found = [(m.start() + 1, -len(m[0]), k, kind, m[0]) for k, (kind, p) in enumerate(patterns.items()) for m in re.finditer(p, text or "")]
        out, end = [], 0
        for start, shorter, _, kind, hit in sorted(found):
            if start > end:
                out.append((start, -shorter, kind, hit))
                end = start - shorter - 1
        return out

    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", spans.of_patterns(F.col("t"), patterns).alias("s")).collect()
    assert all([tuple(x) for x in r["s"]] == loop(texts[r["k"]]) for r in rows)


def plans(spark, questions):
    rows = spark.createDataFrame([(k, q) for k, q in enumerate(questions)], "k int, q string").select("k", semantic_plans.plan(F.col("q")).alias("p")).orderBy("k").collect()
    return [(r["p"]["mode"], list(r["p"]["slots"]), [(o["kind"], o["key"]) for o in r["p"]["objects"]], [tuple(b) for b in r["p"]["bound"]]) for r in rows]


def test_plans(spark):
    got = plans(spark, [
        "Объектом и предметом исследования что является?",
        "Цель работы главы 1; гипотеза в разделе 2.3; таблица 3,1 и рис. А4",
        "Выводы по главам 1-3",
        "Сравни таблицы 2.1 и 2.2 и рисунок 5",
        "Объясни простым языком главу 2",
        "какие задачи исследования и цель и задачи работы в 1 и 3 главе, введение",
        "о чём работа",
        None,
        "главные выводы и актуальность",
        "подраздел 4.1, раздел 4.1 и § 4.1",
        "предмет спора и объект недвижимости",
    ])
    intro = ("section", "intro")
    assert got[0] == ("generic", ["object", "subject"], [intro], [("object", *intro), ("subject", *intro)])
    assert got[1] == ("generic", ["goal", "hypothesis"], [("section", "1"), ("section", "2.3"), ("table", "3.1"), ("figure", "А4")], [("goal", "section", "1"), ("hypothesis", "section", "2.3"), ("hypothesis", "table", "3.1"), ("hypothesis", "figure", "А4")])
    assert got[2][1:3] == (["conclusions"], [("section", "1"), ("section", "2"), ("section", "3")]) and len(got[2][3]) == 3
    assert got[3] == ("compare_objects", [], [("table", "2.1"), ("table", "2.2"), ("figure", "5")], [])
    assert got[4][:3] == ("tutor_overview", ["goal", "tasks", "conclusions"], [("section", "2"), ("section", "1")])
    assert got[5][1] == ["tasks", "goal"] and got[5][2] == [intro, ("section", "1"), ("section", "2"), ("section", "3")]
    assert got[6] == got[7] == ("generic", [], [], [])
    assert got[8][1] == ["conclusions", "relevance"] and got[8][2] == [intro, ("section", "1"), ("section", "2")]
    assert got[9][2] == [("section", "4.1")] and got[10][1] == []
