"""Queries for question understanding, sections and charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from marginalia.functions import questions as Q, semantic_plans
from marginalia.operators import charts, retrieval
from marginalia.plans.registry import query, read


@query("SELECT doc_id, length(text) > 800 OR (length(text) > 400 AND len(regexp_extract_all(lower(text), 'глав|раздел|таблиц|рисун|цель|задач|вывод|метод')) >= 4) AS big FROM documents")
def big_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", Q.big_query(F.col("text")).alias("big"))


@query("""WITH e AS (SELECT user_id, CAST(datediff('day', (SELECT min(ts) FROM events), ts) AS BIGINT) AS d, value FROM events), s AS (SELECT user_id, d, round(sum(value), 4) AS v FROM e GROUP BY ALL),
m AS (SELECT user_id, unnest(range(max(d) + 1)) AS d FROM s GROUP BY user_id) SELECT user_id, d, v FROM m LEFT JOIN s USING (user_id, d)""")
def chart_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sums with a row for every day from the first on."""
    events = read(spark, sf_dir, "events")
    start = events.agg(F.min("ts")).first()[0]
    daily = events.groupBy("user_id", F.datediff(F.col("ts"), F.lit(start)).cast("bigint").alias("d")).agg(F.round(F.sum("value"), 4).alias("v"))
    return charts.fill_gaps(daily, ["user_id"], "d")


SHARES_SQL = """g AS (SELECT o_custkey AS chart, o_orderpriority AS category, o_orderstatus AS series, count(*) AS n FROM orders GROUP BY ALL),
s AS (SELECT *, n * 1.0 / sum(n) OVER (PARTITION BY chart, category) AS v FROM g)"""


@query(f"""WITH {SHARES_SQL}, c AS (SELECT chart, category, sum(v) AS s, max(v) AS m, count(*) AS n FROM s GROUP BY ALL)
SELECT chart, (max(n) = 1 AND sum(s) BETWEEN 0.98 AND 1.02 AND max(m) <= 1) OR (max(n) > 1 AND count(*) >= 2 AND bool_and(s BETWEEN 0.95 AND 1.05 AND m <= 1)) AS percent FROM c GROUP BY chart""")
def chart_percent_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("chart"), F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("series")).agg(F.count("*").alias("n"))
    rows = n.withColumn("v", F.col("n") / F.sum("n").over(Window.partitionBy("chart", "category")))
    return charts.percent_context(rows, "chart", "category", "v")


@query("""WITH c AS (SELECT o_custkey AS chart, o_orderpriority AS category, min(o_orderkey) AS k FROM orders GROUP BY ALL), k AS (SELECT chart, list(category ORDER BY k, category) AS categories FROM c GROUP BY chart),
l AS (SELECT o_custkey AS chart, o_orderstatus AS series, o_orderpriority AS category, arg_max(o_totalprice, o_orderkey) AS v FROM orders GROUP BY ALL)
SELECT k.chart, s.series, k.categories, list_transform(k.categories, lambda c: s.m[c]) AS values FROM k JOIN (SELECT chart, series, map_from_entries(list((category, v))) AS m FROM l GROUP BY ALL) s USING (chart)""")
def chart_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chart"), F.col("o_orderstatus").alias("series"), F.col("o_orderpriority").alias("category"), "o_totalprice", "o_orderkey")
    return charts.pivoted(rows, "chart", "series", "category", "o_totalprice", "o_orderkey")


@query("""WITH s AS (SELECT l_suppkey AS chart, l_returnflag AS series, l_linestatus AS label, avg(l_discount) AS v, CASE WHEN l_suppkey % 2 = 0 THEN '%' ELSE 'шт' END AS unit FROM lineitem GROUP BY ALL),
x AS (SELECT *, unit = '%' AND min(v) OVER w >= 0 AND max(v) OVER w <= 1.2 AS share FROM s WINDOW w AS (PARTITION BY chart, series)), y AS (SELECT *, CASE WHEN share THEN v * 100 ELSE v END AS z FROM x)
SELECT chart, series, label, share, abs(z - round_even(z, 0)) <= 0.05 AS whole FROM y""")
def chart_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which series are shares and which values are shown as whole numbers."""
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("chart"), F.col("l_returnflag").alias("series"), F.col("l_linestatus").alias("label")).agg(F.avg("l_discount").alias("v"))
    rows = charts.shares(rows.withColumn("unit", F.when(F.col("chart") % 2 == 0, "%").otherwise("шт")), ["chart", "series"], "v", "unit")
    line = charts.bullet(F.col("label"), F.col("v"), F.col("unit"), F.col("share"))
    return rows.select("chart", "series", "label", "share", (~F.element_at(F.split(line, ": "), -1).contains(".")).alias("whole"))


@query("""WITH p AS (SELECT p_partkey AS id, p_partkey % 9 + 1 AS a, p_size AS b, p_partkey % 3 AS m, (p_partkey // 2) % 2 = 1 AS w1, (p_partkey // 4) % 2 = 1 AS w2, (p_partkey // 8) % 2 = 1 AS w3, (p_partkey // 16) % 2 = 1 AS w4, (p_partkey // 32) % 2 = 1 AS w5 FROM part),
o AS (SELECT *, [CASE WHEN w1 THEN CAST(a AS VARCHAR) END, CASE WHEN w3 THEN a || '.' || b END] AS named, list_transform(range(a, a + 3), lambda x: CAST(x AS VARCHAR)) AS span FROM p),
s AS (SELECT *, list_filter([CASE WHEN w1 THEN 'goal' END, CASE WHEN w1 THEN 'tasks' END, CASE WHEN w2 THEN 'object' END, CASE WHEN w2 THEN 'subject' END, CASE WHEN w3 THEN 'hypothesis' END, CASE WHEN w5 THEN 'conclusions' END], lambda x: x IS NOT NULL) AS told,
  list_filter(list_concat(named, CASE WHEN w5 THEN span ELSE [] END), lambda x: x IS NOT NULL) AS sections FROM o),
t AS (SELECT *, CASE WHEN m = 1 AND len(sections) > 0 AND NOT (w1 OR w5) THEN list_concat(told, ['goal', 'tasks', 'conclusions']) ELSE told END AS slots FROM s),
f AS (SELECT *, list_distinct(list_concat(CASE WHEN len(slots) > 0 AND len(sections) = 0 THEN ['intro'] ELSE [] END, sections, CASE WHEN list_contains(slots, 'conclusions') THEN ['1', '2'] ELSE [] END)) AS keys FROM t)
SELECT id, ['generic', 'tutor_overview', 'compare_objects'][m + 1] AS mode, array_to_string(slots, ',') AS slots, array_to_string(list_sort(keys), ',') AS sections, CASE WHEN w4 THEN b || '.' || a || ',' || b || '.' || (a + 1) ELSE '' END AS tables, CASE WHEN w4 THEN 'A' || b ELSE '' END AS figures,
  CASE WHEN w1 THEN CAST(a AS VARCHAR) WHEN list_contains(slots, 'goal') THEN array_to_string(list_sort(keys), ',') ELSE '' END AS goal, CASE WHEN w2 AND (w3 OR NOT w4) THEN array_to_string(list_sort(keys), ',') ELSE '' END AS object FROM f""")
def semantic_plan_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of questions put together of up to five clauses with nested names and ranges: mode, slots, objects by kind, and what two of the slots are about."""
    key = F.col("p_partkey")
    a, b, text = key % 9 + 1, F.col("p_size"), lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    when = lambda bit, clause: F.when(F.floor(key / bit) % 2 == 1, clause)
    clauses = [
        when(2, text("Цель и задачи работы главы ", a)), when(4, F.lit("что является объектом и предметом исследования")), when(8, text("какая гипотеза в подразделе ", a, ".", b)),
        when(16, text("таблицы ", b, ",", a, " и ", b, ".", a + 1, " и рис. A", b)), when(32, text("главные выводы по главам ", a, "–", a + 2)),
    ]
    mode = F.element_at(F.array(F.lit("Скажи"), F.lit("Объясни простым языком"), F.lit("Сравни")), (key % 3 + 1).cast("int"))
    rows = retrieval.spread(read(spark, sf_dir, "part").select("p_partkey", "p_size")).select(key.alias("id"), F.concat_ws("; ", mode, *clauses).alias("question"))
    plans = rows.select("id", semantic_plans.plan(F.col("question")).alias("p"))
    keys = lambda kind: F.transform(F.filter("p.objects", lambda o: o["kind"] == kind), lambda o: o["key"])
    about = lambda slot: F.array_join(F.array_sort(F.transform(F.filter("p.bound", lambda o: (o["slot"] == slot) & (o["kind"] == "section")), lambda o: o["key"])), ",")
    return plans.select("id", "p.mode", F.array_join("p.slots", ",").alias("slots"), F.array_join(F.array_sort(keys("section")), ",").alias("sections"), F.array_join(keys("table"), ",").alias("tables"), F.array_join(keys("figure"), ",").alias("figures"), about("goal").alias("goal"), about("object").alias("object"))
