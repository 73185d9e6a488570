"""Queries over recognised words, figures without values, prompts of facts, and attributes of any shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.functions import variants
from marginalia.operators import assignment, charts, layout, prompts
from marginalia.plans.registry import query, read

LINES_SQL = "g AS (SELECT l_orderkey AS id, l_linenumber AS n, CAST(max(l_quantity) AS BIGINT) AS q, max(l_partkey) AS p, max(l_suppkey) AS s FROM lineitem GROUP BY ALL)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n")).agg(F.max("l_quantity").cast("long").alias("q"), F.max("l_partkey").alias("p"), F.max("l_suppkey").alias("s"))


@query(f"""WITH {LINES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n) AS k FROM g)
SELECT id, CAST(0 AS INTEGER) AS row_idx, 'line | part | amount total' AS cells FROM g GROUP BY id
UNION ALL SELECT id, CAST(k AS INTEGER), n || ' | ' || CASE WHEN p % 5 = 0 THEN '' ELSE CAST(p AS VARCHAR) END || ' | ' || CASE WHEN s % 2 = 0 THEN q || ' pieces' ELSE CAST(q AS VARCHAR) END FROM r""")
def recognised_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of orders rebuilt from the boxes of their words, which jitter in both directions; some cells are empty, some have two words."""
    from pyspark.sql import Window

    g = _lines(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("n")))
    word = lambda col, at, text: F.struct(F.lit(col).alias("col"), F.lit(at).alias("at"), text.alias("text"))
    body = g.select("id", "k", "p", "s", F.explode(F.array(word(0, 0, F.col("n").cast("string")), word(1, 0, F.when(F.col("p") % 5 == 0, "").otherwise(F.col("p").cast("string"))), word(2, 0, F.col("q").cast("string")), word(2, 1, F.when(F.col("s") % 2 == 0, "pieces").otherwise("")))).alias("w"))
    head = g.select("id").distinct().select("id", F.lit(0).alias("k"), F.lit(3).alias("p"), F.lit(4).alias("s"), F.explode(F.array(word(0, 0, F.lit("line")), word(1, 0, F.lit("part")), word(2, 0, F.lit("amount")), word(2, 1, F.lit("total")))).alias("w"))
    rows = body.unionByName(head).select("id", "k", "p", "s", "w.*")
    left = F.col("col") * 300.0 + F.col("at") * 90 + F.col("p") % 13
    top = F.col("k") * 40.0 + (F.col("s") + F.col("col")) % 9
    boxes = rows.select("id", left.alias("left"), (left + 10 * F.length("text")).alias("right"), top.alias("top"), (top + 12).alias("bottom"), "text")
    found = layout.grid_of_words(boxes, ["id"], line_gap=15, column_gap=60)
    return found.select("id", "row_idx", F.array_join("cells", " | ").alias("cells"))


@query("""WITH o AS (SELECT o_custkey AS doc, o_orderkey AS id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS k FROM orders),
l AS (SELECT doc, id AS left_id, k * 100 AS at FROM o), r AS (SELECT doc, id AS right_id, k * 100 + id % 37 AS at FROM o WHERE id % 4 <> 0)
SELECT l.doc, left_id, right_id, CAST(r.at - l.at AS INTEGER) AS distance FROM l JOIN r ON l.doc = r.doc AND left_id = right_id""")
def values_by_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of each document brought together with the numbers near them, one to one; a fourth of the labels has none of its own."""
    from pyspark.sql import Window

    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("k"))
    labels = o.select("doc", F.col("id").alias("left_id"), (F.col("k") * 100).alias("at"))
    values = o.where("id % 4 <> 0").select("doc", F.col("id").alias("right_id"), (F.col("k") * 100 + F.col("id") % 37).cast("int").alias("at"))
    return assignment.nearest_pairs(labels, values, ["doc"], 40).select("doc", "left_id", "right_id", F.col("distance").cast("int").alias("distance"))


@query("""WITH f AS (SELECT l_suppkey AS q, l_shipmode AS kind, l_orderkey * 10 + l_linenumber AS i, max(10 + l_partkey % 90) AS n FROM (SELECT *, CASE l_linenumber % 3 WHEN 0 THEN 'notes' WHEN 1 THEN 'tables' ELSE 'values' END AS l_shipmode FROM lineitem WHERE l_linenumber < 6 AND (l_linenumber % 3 > 0 OR l_orderkey % 40 = 0)) GROUP BY ALL),
t AS (SELECT q, kind, sum(n) AS total FROM f GROUP BY ALL), o AS (SELECT *, coalesce(sum(total) OVER (PARTITION BY q ORDER BY total, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, count(*) OVER (PARTITION BY q) - row_number() OVER (PARTITION BY q ORDER BY total, kind) + 1 AS rest FROM t),
v AS (SELECT *, (1500 - before) // rest AS level FROM o), s AS (SELECT *, (SELECT w.level FROM v w WHERE w.q = v.q AND w.level < w.total ORDER BY w.total, w.kind LIMIT 1) AS lid, (SELECT w.total FROM v w WHERE w.q = v.q AND w.level < w.total ORDER BY w.total, w.kind LIMIT 1) AS from_total, (SELECT w.kind FROM v w WHERE w.q = v.q AND w.level < w.total ORDER BY w.total, w.kind LIMIT 1) AS from_kind FROM v),
share AS (SELECT q, kind, CASE WHEN lid IS NULL OR (total, kind) < (from_total, from_kind) THEN total ELSE greatest(lid, 0) END AS share FROM s),
r AS (SELECT f.*, sum(n) OVER (PARTITION BY q, kind ORDER BY i) <= share AS own FROM f JOIN share USING (q, kind)),
m AS (SELECT *, sum(CASE WHEN own THEN n ELSE 0 END) OVER (PARTITION BY q) AS spent, sum(CASE WHEN own THEN 0 ELSE n END) OVER (PARTITION BY q ORDER BY kind, i) AS more FROM r)
SELECT q, kind, i, n FROM m WHERE own OR spent + more <= 1500""")
def facts_in_a_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of three kinds for each question, chosen under a budget of which the small kind needs little."""
    line = F.col("l_linenumber")
    rows = read(spark, sf_dir, "lineitem").where("l_linenumber < 6 AND (l_linenumber % 3 > 0 OR l_orderkey % 40 = 0)")
    kind = F.element_at(F.array(F.lit("notes"), F.lit("tables"), F.lit("values")), (line % 3 + 1).cast("int"))
    facts = rows.groupBy(F.col("l_suppkey").alias("q"), kind.alias("kind"), (F.col("l_orderkey") * 10 + line).alias("i")).agg(F.max(10 + F.col("l_partkey") % 90).alias("n"))
    return prompts.chosen(facts, ["q"], "kind", ["i"], F.col("n"), 1500).select("q", "kind", "i", "n")


SHAPES_SQL = """p AS (SELECT p_partkey AS id, p_partkey % 7 AS shape, p_size AS a, p_partkey % 90 + 1 AS b, p_brand AS x, p_type AS y FROM (SELECT p_partkey, p_size, p_brand, 'kind ' || p_partkey % 5 AS p_type FROM part)),
v AS (SELECT id, CAST(0 AS INTEGER) AS place, CASE WHEN shape IN (2, 3) THEN 's1' END AS series, x AS label, CAST(a AS DOUBLE) AS value, CASE WHEN shape IN (0, 2) THEN '%' END AS unit FROM p WHERE shape < 5
UNION ALL SELECT id, 1, CASE WHEN shape = 0 THEN 'own' WHEN shape IN (2, 3) THEN 's1' END, y, CASE WHEN shape = 1 THEN NULL ELSE CAST(b AS DOUBLE) END, CASE WHEN shape = 2 THEN '%' END FROM p WHERE shape < 5
UNION ALL SELECT id, 2, 's2', x, CAST(a * 2 AS DOUBLE), CASE WHEN shape = 2 THEN 'шт' END FROM p WHERE shape IN (2, 3)
UNION ALL SELECT id, 3, 's2', y, NULL, CASE WHEN shape = 2 THEN 'шт' END FROM p WHERE shape IN (2, 3))"""


def _attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and attrs of charts in five forms, and of texts that hold none or are broken."""
    key = F.col("p_partkey")
    p = read(spark, sf_dir, "part").select(key.alias("id"), (key % 7).alias("shape"), F.col("p_size").cast("string").alias("a"), (key % 90 + 1).cast("string").alias("b"), (F.col("p_size") * 2).cast("string").alias("c"), F.col("p_brand").alias("x"), F.concat(F.lit("kind "), (key % 5).cast("string")).alias("y"))
    forms = [
        '{"chart_data": [{"label": "%4$s", "value": %1$s, "unit": "%%"}, {"name": "%5$s", "y": %2$s, "series_name": "own"}, {"value": 3}]}',
        '{"other": {}, "chart_data": [["%4$s", %1$s], ["%5$s", "text"]]}',
        '{"chart_data": {"categories": ["%4$s", "%5$s"], "unit": "%%", "series": [{"name": "s1", "values": [%1$s, %2$s]}, {"title": "s2", "data": [%3$s], "unit": "шт"}]}}',
        '{"chart_data": "none", "chart_matrix": {"labels": ["%4$s", "%5$s"], "series": [{"name": "s1", "values": [%1$s, %2$s]}, {"name": "s2", "values": [%3$s]}]}}',
        '{"chart_data": [], "chart_matrix": {"labels": ["%4$s", "%5$s"], "values": [%1$s, %2$s]}}',
        '{"chart_data": "%4$s"}', '{"chart_data": [%1$s',
    ]
    return p.select("id", F.element_at(F.array(*[F.format_string(f, "a", "b", "c", "x", "y") for f in forms]), (F.col("shape") + 1).cast("int")).alias("attrs"))


@query(f"WITH {SHAPES_SQL} SELECT id, place, series, label, value, unit FROM v")
def chart_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of charts whose attributes come in five forms, among broken and chartless ones."""
    return variants.chart_points(_attributes(spark, sf_dir), "id", "attrs")


@query(f"WITH {SHAPES_SQL} SELECT id, count(value) AS n, sum(value) AS total, min(value) AS low, max(value) AS high, 'Сумма = ' || CAST(sum(value) AS BIGINT) || '; мин = ' || CAST(min(value) AS BIGINT) || '; макс = ' || CAST(max(value) AS BIGINT) AS text FROM v GROUP BY id")
def chart_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum, least and largest of all numbers of each of these charts."""
    return charts.summary(variants.chart_points(_attributes(spark, sf_dir), "id", "attrs"), "id")
