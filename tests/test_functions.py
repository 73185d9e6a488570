"""Numbers, labels, questions and folds on known cases and against plain Python."""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from marginalia.functions import labels, numbers, questions
from marginalia.operators import aggregates, joins, retrieval, tables
from marginalia.sources import catalog, chunks


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'array<string>' if isinstance(v, list) else 'long'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_number_parsers(spark):
    assert one(spark, numbers.plain_number(F.col("t")), t="(1 234,5)") == -1234.5
    assert one(spark, numbers.plain_number(F.col("t")), t="1,234.56") == 1.234  # one separator only
    assert one(spark, numbers.plain_number(F.col("t")), t=None) is None
    assert one(spark, numbers.with_unit(F.col("t")), t="5k")["value"] == 5.0  # no boundary before the letter
    assert one(spark, numbers.all_numbers(F.col("t")), t="N=40, 20 матерей; 1 234 567 и -3,5 тыс") == [40.0, 20.0, 1234567.0, -3500.0]
    assert one(spark, numbers.cell_number(F.col("t")), t="12%") is None


def test_rounding_and_tolerance(spark):
    close = lambda a, b, kind, q="": one(spark, numbers.adaptive_close(F.col("a"), F.col("b"), F.lit(kind), F.lit(q)), a=a, b=b)
    assert close(100.0, 101.1, "percent") and not close(10.0, 11.3, "percent")
    assert close(10.0, 11.3, "percent", "low")
    assert close(1_000_000.0, 1_019_000.0, "money") and not close(1_000_000.0, 1_030_000.0, "money")


def test_headings(spark):
    head = lambda t: one(spark, labels.is_heading(F.col("t")), t=t)
    assert head("1.2 Анализ рынка") and head("ВВЕДЕНИЕ") and head("Глава первая")
    assert not head("a = b") and not head("Обычное предложение текста.") and not head("ab")
    assert one(spark, labels.heading_level(F.col("t")), t="1.2.3 X") == 3


def test_word_numbers_keep_other_words(spark):
    assert one(spark, questions.with_digits(F.col("t")), t="первенство и вторник") == "первенство и вторник"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab c", max_size=30), min_size=1, max_size=12))
def test_greedy_packing_as_in_a_loop(spark, paragraphs):
    done, cur = [], ""
    for p in paragraphs:
        if len(cur) + len(p) + 1 <= 40:
            cur = p if cur == "" else cur + "\n\n" + p
        else:
            done += [cur] if cur else []
            cur = p
    done += [cur] if cur else []
    assert one(spark, chunks.pack(F.col("p"), 40), p=paragraphs) == done


def test_lossy_packing(spark):
    assert one(spark, chunks.pack(F.col("p"), 10, keep_all=False, tail=4), p=["0123456789abcdef"]) == ["cdef"]


def test_upper_median(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0), (1, 4.0), (2, 7.0), (2, 7.0), (3, 5.0)], "k int, x double")
    got = {r["k"]: (r["n"], r["x"]) for r in aggregates.upper_medians(rows, ["k"], ["x"]).collect()}
    assert got == {1: (4, 3.0), 2: (2, 7.0), 3: (1, 5.0)}
    assert aggregates.upper_medians(rows.limit(0), ["k"], ["x"]).count() == 0


def test_band_join_is_the_theta_join(spark):
    a = spark.createDataFrame([(1, i) for i in (0, 5, 9)], "k int, anchor long")
    b = spark.createDataFrame([(1, i) for i in range(-4, 14)], "k int, id long")
    got = {(r["anchor"], r["id"]) for r in joins.band(a, b, ["k"], "anchor", "id", 3, 2).collect()}
    assert got == {(x, y) for x in (0, 5, 9) for y in range(-4, 14) if x - 3 <= y <= x + 2}


def test_upsert_keeps_what_a_null_does_not_change(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id int, name string, v double")
    new = spark.createDataFrame([(2, None, 5.0, 1), (2, "c", None, 2), (3, "d", 7.0, 1)], "id int, name string, v double, o int")
    got = {r["id"]: (r["name"], r["v"]) for r in catalog.upsert(old, new, ["id"], "o").collect()}
    assert got == {1: ("a", 1.0), 2: ("c", 2.0), 3: ("d", 7.0)}


def test_header_detection(spark):
    rows = spark.createDataFrame([(1, 1, ["Год", "Выручка"]), (1, 2, ["2019", "10"]), (2, 1, ["5", "6"]), (2, 2, ["7", "8"])], "t int, r int, cells array<string>")
    got = {r["t"]: r["has_header"] for r in tables.has_header(rows, ["t"], F.col("cells"), "r").collect()}
    assert got == {1: True, 2: False}


def test_verbatim_finds_ends_and_short_pieces(spark):
    words = " ".join(f"word{i:02}x" for i in range(18))[:150]
    assert one(spark, retrieval.shingles(F.col("t")), t=words) == [words[i : i + 90] for i in (0, 25, 50, 75, 100)]  # as the reference's _make_shingles
    assert one(spark, retrieval.shingles(F.col("t")), t=words[:90]) == [words[:90]]
    dense = "語" * 89 + "終"
    docs = spark.createDataFrame([(1, f"so {words[100:]} it ends"), (2, "see Short Item here"), (3, f"x{dense}y"), (4, "nothing")], "doc_id long, text string")
    items = spark.createDataFrame([(1, words), (2, "short item"), (3, dense), (4, ""), (5, " "), (6, None)], "item_id long, text string")
    got = sorted(tuple(r) for r in retrieval.verbatim(docs, items).select("item_id", "doc_id", "piece_no", "at").collect())
    assert got == [(1, 1, 4, 4), (2, 2, 0, 5), (3, 3, 0, 2)]
