"""Queries for table analytics and consistency checks, on grids made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from marginalia.functions import expressions
from marginalia.operators import checks, retrieval, tables
from marginalia.plans.registry import query, read

GRID = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CELLS_SQL = """r AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_discount, l_tax) AS row_idx, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem),
cells AS (SELECT l_suppkey, row_idx, unnest([0, 1, 2, 3]) AS col_idx, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value FROM r)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", *GRID)
    return tables.melt(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_tax"], GRID)


@query(f"WITH {CELLS_SQL} SELECT l_suppkey, col_idx, count(*) AS rows, count(value) AS n, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, min(value) AS least, max(value) AS most FROM cells GROUP BY ALL HAVING count(value) >= greatest(1, floor(count(*) * 0.6))")
def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.column_stats(_cells(spark, sf_dir), ["l_suppkey"])


@query(f"WITH {CELLS_SQL} SELECT l_suppkey, col_idx, row_idx, value, row_number() OVER (PARTITION BY l_suppkey, col_idx ORDER BY value DESC, row_idx) AS place FROM cells QUALIFY place <= 5")
def top_rows_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_suppkey", "col_idx").orderBy(F.desc("value"), "row_idx")
    return _cells(spark, sf_dir).drop("header").withColumn("place", F.row_number().over(w)).where("place <= 5")


@query(f"""WITH {CELLS_SQL}, f AS (SELECT l_suppkey, col_idx, row_idx, CASE WHEN col_idx = 3 THEN value * 100 ELSE value END AS value, col_idx = 3 AS had FROM cells),
s AS (SELECT *, count(value) OVER c AS n, count(*) FILTER (had) OVER c AS signed, count(*) FILTER (value BETWEEN 0 AND 1.2) OVER c AS small FROM f WINDOW c AS (PARTITION BY l_suppkey, col_idx)),
p AS (SELECT *, (signed * 2 >= n AND signed > 0) OR (signed = 0 AND n >= 3 AND small >= ceil(n * 0.8)) AS percent FROM s)
SELECT l_suppkey, col_idx, bool_or(percent) AS percent, round(sum(CASE WHEN percent AND value > 1.2 THEN value / 100 ELSE value END), 4) AS total FROM p GROUP BY ALL""")
def percent_column_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of shares and columns with the sign, brought to shares."""
    cells = _cells(spark, sf_dir).withColumn("had", F.col("col_idx") == 3).withColumn("value", F.when(F.col("had"), F.col("value") * 100).otherwise(F.col("value")))
    return tables.percent_columns(cells, ["l_suppkey"]).groupBy("l_suppkey", "col_idx").agg(F.bool_or("percent").alias("percent"), F.round(F.sum("share"), 4).alias("total"))


@query("""WITH s AS (SELECT l_orderkey AS table_id, count(*) AS n, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1 HAVING count(*) >= 2),
b AS (SELECT o_custkey AS table_id, sum(o_totalprice) AS s FROM orders GROUP BY 1 HAVING count(*) >= 2)
SELECT 'table_total' AS kind, table_id, '0' AS place, abs(s - o_totalprice) <= greatest(1e-6, 3e-3 * greatest(1, abs(s), abs(o_totalprice))) AS ok, round(s, 4) AS expected, round(o_totalprice, 4) AS given FROM s JOIN orders ON o_orderkey = table_id
UNION ALL SELECT 'table_total', table_id, '1', abs(s - t) <= greatest(1e-6, 3e-3 * greatest(1, abs(s), abs(t))), round(s, 4), round(t, 4) FROM (SELECT *, s * CASE WHEN table_id % 9 = 0 THEN 1.01 ELSE 1.0 END AS t FROM b)""")
def totals_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals against their lines (they differ), and customers' totals against their orders with planted faults."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("table_id"), F.lit(0).alias("col_idx"), F.col("l_extendedprice").alias("value"))
    stated = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("table_id"), F.lit(0).alias("col_idx"), F.col("o_totalprice").alias("total"))
    spent = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("table_id"), F.lit(1).alias("col_idx"), F.col("o_totalprice").alias("value"))
    fault = F.when(F.col("table_id") % 9 == 0, 1.01).otherwise(1.0)
    sums = spent.groupBy("table_id", "col_idx").agg(F.sum("value").alias("total")).withColumn("total", F.col("total") * fault)
    return checks.totals(lines, stated, "table_id").unionByName(checks.totals(spent, sums, "table_id"))


YEARS_SQL = """y AS (SELECT c_nationkey AS table_id, c_mktsegment AS row, sum(CASE WHEN year(o_orderdate) = 1994 THEN o_totalprice ELSE 0 END) AS prev, sum(CASE WHEN year(o_orderdate) = 1995 THEN o_totalprice ELSE 0 END) AS cur FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
g AS (SELECT *, (cur - prev) * CASE WHEN table_id % 5 = 1 THEN 1.5 ELSE 1 END AS diff, CASE WHEN abs(prev) >= 1e-12 THEN cur / prev * 100 - CASE WHEN table_id % 2 = 0 THEN 100 ELSE 0 END + CASE WHEN row = 'BUILDING' THEN 7 ELSE 0 END END AS pct FROM y)"""


def _years(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    sums = [F.sum(F.when(F.year("o_orderdate") == y, F.col("o_totalprice")).otherwise(0.0)).alias(n) for y, n in ((1994, "prev"), (1995, "cur"))]
    rows = both.groupBy(F.col("c_nationkey").alias("table_id"), F.col("c_mktsegment").alias("row")).agg(*sums)
    rows = rows.withColumn("diff", (F.col("cur") - F.col("prev")) * F.when(F.col("table_id") % 5 == 1, 1.5).otherwise(1.0))
    pct = F.when(F.abs("prev") >= 1e-12, F.try_divide(F.col("cur"), F.col("prev")) * 100 - F.when(F.col("table_id") % 2 == 0, 100).otherwise(0) + F.when(F.col("row") == "BUILDING", 7).otherwise(0))
    return rows.withColumn("pct", pct)


@query(f"""WITH {YEARS_SQL}, p AS (SELECT *, cur / prev * 100 AS a, cur / prev * 100 - 100 AS b FROM g WHERE pct IS NOT NULL AND abs(prev) >= 1e-12),
m AS (SELECT table_id, count(*) AS n, list_sort(list(abs(a - pct)))[count(*) // 2 + 1] AS ma, list_sort(list(abs(b - pct)))[count(*) // 2 + 1] AS mb FROM p GROUP BY 1)
SELECT 'table_delta' AS kind, table_id, row AS place, abs(cur - prev - diff) <= greatest(CASE WHEN greatest(abs(cur), abs(prev)) < 50 THEN 0.5 ELSE 1 END, 0.01 * greatest(1, abs(cur - prev), abs(diff))) AS ok, round(cur - prev, 4) AS expected, round(diff, 4) AS given FROM g
UNION ALL SELECT 'table_percent', table_id, row, abs(CASE WHEN ma <= mb THEN a ELSE b END - pct) <= 1.2, round(CASE WHEN ma <= mb THEN a ELSE b END, 4), round(pct, 4) FROM p JOIN m USING (table_id) WHERE n >= 3""")
def delta_growth_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated differences and growth rates of two years, with planted faults; the growth formula is found for each table."""
    rows = _years(spark, sf_dir)
    return checks.delta(rows, "table_id", "row").unionByName(checks.growth(rows, "table_id", "row"))


@query("""WITH r AS (SELECT s_nationkey AS table_id, s_suppkey AS row_idx, CAST(s_suppkey % 13 + 2 AS DOUBLE) AS c0, CAST(s_suppkey % 7 + 3 AS DOUBLE) AS c1 FROM supplier),
w AS (SELECT *, c0 * c1 + CASE WHEN row_idx % 11 = 0 THEN 50 ELSE 0 END AS c2 FROM r), x AS (SELECT *, c2 - c0 AS c3 FROM w),
cells AS (SELECT table_id, row_idx, unnest([0, 1, 2, 3]) AS col, unnest([c0, c1, c2, c3]) AS v FROM x),
t AS (SELECT t.table_id, t.row_idx, t.col AS target, a.col AS a, b.col AS b, t.v AS given, a.v AS x, b.v AS y, op FROM cells t JOIN cells a ON a.table_id = t.table_id AND a.row_idx = t.row_idx AND a.col <> t.col JOIN cells b ON b.table_id = t.table_id AND b.row_idx = t.row_idx AND b.col <> t.col AND b.col > a.col, (SELECT unnest(['add', 'sub', 'rsub', 'mul', 'div', 'rdiv']) AS op)),
e AS (SELECT *, CASE op WHEN 'add' THEN x + y WHEN 'sub' THEN x - y WHEN 'rsub' THEN y - x WHEN 'mul' THEN x * y WHEN 'div' THEN CASE WHEN abs(y) >= 1e-12 THEN x / y END ELSE CASE WHEN abs(x) >= 1e-12 THEN y / x END END AS expected FROM t),
k AS (SELECT *, abs(expected - given) <= greatest(0.02, 0.03 * greatest(1, abs(expected), abs(given))) AS good FROM e WHERE expected IS NOT NULL),
rules AS (SELECT table_id, target, a, b, op, count(*) AS n, count(*) FILTER (good) AS hits, round(avg(abs(expected - given)), 6) AS err FROM k GROUP BY ALL HAVING count(*) >= 3 AND count(*) FILTER (good) >= count(*) * 0.72),
best AS (SELECT * FROM rules QUALIFY row_number() OVER (PARTITION BY table_id, target ORDER BY hits / n DESC, hits DESC, err, a, b, op) = 1)
SELECT table_id, target, a, b, op, n, hits, coalesce((SELECT string_agg(CAST(row_idx AS VARCHAR), ',' ORDER BY row_idx) FROM k WHERE k.table_id = best.table_id AND k.target = best.target AND k.a = best.a AND k.b = best.b AND k.op = best.op AND NOT good), '') AS exceptions FROM best""")
def infer_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules between the columns of a grid with a product and a difference, and the rows that break them."""
    rows = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("table_id"), F.col("s_suppkey").alias("row_idx"), (F.col("s_suppkey") % 13 + 2).cast("double").alias("c0"), (F.col("s_suppkey") % 7 + 3).cast("double").alias("c1"))
    rows = rows.withColumn("c2", F.col("c0") * F.col("c1") + F.when(F.col("row_idx") % 11 == 0, 50).otherwise(0)).withColumn("c3", F.col("c2") - F.col("c0"))
    cells = rows.select("table_id", "row_idx", F.posexplode(F.array("c0", "c1", "c2", "c3")).alias("col_idx", "value"))
    return checks.inferred(cells, "table_id", least_rows=3)


FACTS_SQL = """f AS (SELECT c_mktsegment || '/' || c_nationkey AS label, 1 AS table_id, sum(c_acctbal) AS value FROM customer GROUP BY ALL),
g AS (SELECT label, 2 AS table_id, value * CASE WHEN ascii(label) % 2 = 0 THEN 1.001 ELSE 1000 END AS value FROM f), h AS (SELECT label, 3 AS table_id, value + 1500 AS value FROM f WHERE contains(label, '1')),
u AS (SELECT label, 2024 AS year, 'money' AS kind, value, CAST(1 AS DOUBLE) AS scale, table_id FROM (SELECT * FROM f UNION ALL SELECT * FROM g UNION ALL SELECT * FROM h))"""


@query(f"""WITH {FACTS_SQL}, m AS (SELECT label, count(DISTINCT table_id) AS tables, list_sort(list(value))[count(*) // 2 + 1] AS median FROM u GROUP BY label)
SELECT u.label, year, table_id, tables, round(median, 2) AS median, round(value, 2) AS value, abs(median - value) <= greatest(2000.0, 0.005 * greatest(1, abs(median), abs(value))) AS ok,
  CASE WHEN greatest(median, value) / greatest(least(median, value), 1e-12) BETWEEN 900 AND 1100 OR greatest(median, value) / greatest(least(median, value), 1e-12) BETWEEN 9e5 AND 1.1e6 THEN 'scale' ELSE '' END AS hint FROM u JOIN m USING (label) WHERE tables >= 2""")
def cross_table_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same measure in up to three tables against the upper median, with a hint where only the scale differs."""
    f = read(spark, sf_dir, "customer").groupBy(F.concat_ws("/", "c_mktsegment", "c_nationkey").alias("label")).agg(F.sum("c_acctbal").alias("value"))
    g = f.withColumn("value", F.col("value") * F.when(F.ascii("label") % 2 == 0, 1.001).otherwise(1000.0))
    h = f.where(F.col("label").contains("1")).withColumn("value", F.col("value") + 1500)
    facts = f.withColumn("table_id", F.lit(1)).unionByName(g.withColumn("table_id", F.lit(2))).unionByName(h.withColumn("table_id", F.lit(3)))
    return checks.cross_table(facts.select("label", F.lit(2024).alias("year"), F.lit("money").alias("kind"), "value", F.lit(1.0).alias("scale"), "table_id"))


@query("""WITH s AS (SELECT o_custkey AS label, year(o_orderdate) AS year, sum(o_totalprice) AS t FROM orders GROUP BY 1, 2), y AS (SELECT label, year, t - CASE WHEN label % 50 = 0 THEN 1e6 ELSE 0 END AS value FROM s),
r AS (SELECT *, lag(value) OVER (PARTITION BY label ORDER BY year) AS b FROM y), j AS (SELECT *, abs(value / nullif(b, 0)) AS ratio, coalesce(abs(value / nullif(b, 0)) > 30 AND abs(b) >= 1e-12, false) AS jump FROM r),
k AS (SELECT *, sum(CASE WHEN jump THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY year ROWS UNBOUNDED PRECEDING) AS jumps FROM j)
SELECT label, year, round(value, 4) AS value, round(ratio, 4) AS ratio, CASE WHEN jump AND jumps = 1 THEN 'jump' ELSE 'negative' END AS found FROM k WHERE (jump AND jumps = 1) OR value < 0""")
def trend_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("label"), F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("value"))
    rows = rows.withColumn("value", F.col("value") - F.when(F.col("label") % 50 == 0, 1e6).otherwise(0.0))
    return checks.trend(rows, "label", "year")


@query("""WITH p AS (SELECT source, count(*) AS n, 100.0 * count(*) FILTER (lang = 'en') / count(*) AS p FROM documents GROUP BY source), s AS (SELECT *, p + CASE WHEN n % 2 = 1 THEN 1.3 ELSE 0.1 END AS given, 100.0 / n AS step FROM p),
k AS (SELECT *, round_even(given / step, 0) AS k FROM s WHERE step >= 0.25)
SELECT source, n, CAST(k AS BIGINT) AS k, round(k * step, 4) AS expected, abs(given - k * step) <= greatest(0.35, 0.15 * step) AND given BETWEEN -0.5 AND 100.5 AS ok FROM k""")
def denominator_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether stated shares can come from their number of cases."""
    rows = read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("e"))
    given = 100.0 * F.col("e") / F.col("n") + F.when(F.col("n") % 2 == 1, 1.3).otherwise(0.1)
    return rows.select("source", "n", checks.denominator(given, F.col("n")).alias("c")).where("c IS NOT NULL").select("source", "n", "c.k", "c.expected", "c.ok")


@query("""WITH p AS (SELECT p_partkey AS id, p_size AS a, p_partkey % 50 + 1 AS b, p_partkey % 4 AS o FROM part),
v AS (SELECT *, CASE o WHEN 0 THEN a + b WHEN 1 THEN a - b WHEN 2 THEN a * b ELSE a / b END AS value FROM p WHERE NOT (o = 1 AND a < b))
SELECT id, ['+', '-', '*', '/'][o + 1] AS op, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, round(value + CASE WHEN id % 10 = 0 THEN 5 ELSE 0 END, 3) AS c, abs(value - round(value + CASE WHEN id % 10 = 0 THEN 5 ELSE 0 END, 3)) <= greatest(1e-6, 2e-3 * greatest(1, abs(value), abs(round(value + CASE WHEN id % 10 = 0 THEN 5 ELSE 0 END, 3)))) AS ok FROM v""")
def simple_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas written into sentences and read back, a tenth of them wrong."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("a"), (F.col("p_partkey") % 50 + 1).alias("b"), (F.col("p_partkey") % 4).alias("o")).where("NOT (o = 1 AND a < b)")
    value = F.when(F.col("o") == 0, F.col("a") + F.col("b")).when(F.col("o") == 1, F.col("a") - F.col("b")).when(F.col("o") == 2, F.col("a") * F.col("b")).otherwise(F.col("a") / F.col("b"))
    stated = F.round(value + F.when(F.col("id") % 10 == 0, 5).otherwise(0), 3)
    op = F.element_at(F.array(*map(F.lit, ["+", "−", "×", "/"])), (F.col("o") + 1).cast("int"))
    text = F.concat(F.lit("расчёт: "), F.col("a").cast("string"), F.lit(" "), op, F.lit(" "), F.col("b").cast("string"), F.lit(" = "), F.regexp_replace(F.format_number(stated, 3), ",", ""), F.lit(" ."))
    return p.select("id", F.explode(checks.formulas(text)).alias("f")).select("id", "f.op", "f.a", "f.b", "f.c", "f.ok")


@query("""WITH o AS (SELECT o_orderkey AS id, o_totalprice AS rev, o_totalprice * 0.6 AS cost, o_totalprice * CASE WHEN o_orderkey % 8 = 0 THEN 0.5 ELSE 0.4 END AS profit FROM orders)
SELECT id, CAST(id % 3 AS INTEGER) AS pos, round(rev - cost, 4) AS expected, round(profit, 4) AS given, abs(rev - cost - profit) <= greatest(1e-6, 2e-3 * greatest(1, abs(rev - cost), abs(profit))) AS ok FROM o""")
def revenue_cost_profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profit against revenue less cost, each in a sentence of its own behind none to two others, found by windows of three chunks."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("r"))
    profit = F.col("r") * F.when(F.col("id") % 8 == 0, 0.5).otherwise(0.4)
    said = [F.concat(F.lit(w + " составила "), F.regexp_replace(F.format_number(v, 6), ",", ""), F.lit(" руб")) for w, v in [("Выручка", F.col("r")), ("Себестоимость", F.col("r") * 0.6), ("Прибыль", profit)]]
    texts = F.concat(F.array_repeat(F.lit("Об отчёте."), (F.col("id") % 3).cast("int")), F.array(*said), F.array(F.lit("Конец.")))
    return checks.revenue_cost_profit(o.select("id", F.posexplode(texts).alias("pos", "text")), "id", "pos")


@query("""WITH r AS (SELECT n_regionkey AS table_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k, n_name, n_nationkey FROM nation),
l AS (SELECT r_regionkey AS table_id, 0 AS k, '| name | key |' AS md, 'name,key' AS csv FROM region UNION ALL SELECT table_id, k, '| ' || n_name || ' | ' || n_nationkey || ' |', n_name || ',' || n_nationkey FROM r)
SELECT table_id, string_agg(md, chr(10) ORDER BY k) AS md, string_agg(csv, chr(10) ORDER BY k) AS csv FROM l GROUP BY table_id""")
def reconstruct_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a table put together in order, with a header, as Markdown and as CSV."""
    rows = read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("table_id"), F.col("n_nationkey").alias("k"), F.array("n_name", F.col("n_nationkey").cast("string")).alias("cells"))
    head = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("table_id"), F.lit(-1).alias("k"), F.array(F.lit("name"), F.lit("key")).alias("cells"))
    lines = rows.unionByName(head).select("table_id", F.struct("k", tables.markdown(F.col("cells")).alias("md"), tables.csv_line(F.col("cells")).alias("csv")).alias("l"))
    got = lines.groupBy("table_id").agg(F.sort_array(F.collect_list("l")).alias("l"))
    return got.select("table_id", F.array_join(F.transform("l", lambda x: x["md"]), "\n").alias("md"), F.array_join(F.transform("l", lambda x: x["csv"]), "\n").alias("csv"))


@query("""WITH d AS (SELECT l_returnflag AS kind, l_linestatus AS message, l_linenumber % 2 = 0 AS ok, l_suppkey FROM lineitem GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, ok ORDER BY contains(kind, 'percent'), kind, message) AS n FROM d),
k AS (SELECT * FROM q WHERE n <= CASE WHEN ok THEN 2 ELSE 4 END)
SELECT l_suppkey, kind, message, ok, row_number() OVER (PARTITION BY l_suppkey ORDER BY ok, contains(kind, 'percent'), kind, message) AS place FROM k""")
def checks_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct findings of each report, faults first, under quotas."""
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("message"), (F.col("l_linenumber") % 2 == 0).alias("ok"))
    return checks.ordered(rows, ["l_suppkey"], "message", 4, 2)


@query("""WITH p AS (SELECT p_partkey AS id, p_size AS a, p_partkey % 50 + 1 AS b, p_partkey % 7 + 2 AS c, p_partkey % 1000 + 11000 AS d, p_partkey % 6 AS shape, p_partkey % 10 = 0 AS off FROM part),
v AS (SELECT *, CASE shape WHEN 0 THEN (a + b) * c - d WHEN 1 THEN d - (a - (b - c)) WHEN 2 THEN a * (b + (c + d) * 2) WHEN 3 THEN -(a + b) * -c WHEN 4 THEN a + b * c WHEN 5 THEN d END AS x FROM p),
s AS (SELECT *, CAST(x AS DOUBLE) AS value, CAST(x + CASE WHEN off THEN 5 + abs(x) ELSE 0 END AS DOUBLE) AS stated FROM v)
SELECT id, CASE WHEN shape = 5 THEN 'equality' ELSE 'formula' END AS kind, value, stated, NOT off AS ok FROM s
UNION ALL SELECT id, 'bare', CAST(d * c - b AS DOUBLE), NULL, NULL FROM s WHERE NOT off""")
def arithmetic_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested expressions, equalities and expressions without a result, written into texts and read back; a tenth of the results are wrong, and their texts' bare expressions are not counted then."""
    key = F.col("p_partkey")
    p = retrieval.spread(read(spark, sf_dir, "part").select("p_partkey", "p_size")).select(key.alias("id"), F.col("p_size").alias("a"), (key % 50 + 1).alias("b"), (key % 7 + 2).alias("c"), (key % 1000 + 11000).alias("d"), (key % 6).alias("shape"), (key % 10 == 0).alias("off"))
    shapes = ["(%1$d + %2$d) × %3$d − %4$d", "%4$d - (%1$d − (%2$d - %3$d))", "%1$d * (%2$d + (%3$d + %4$d) * 2)", "-(%1$d + %2$d) × -%3$d", "%1$d + %2$d x %3$d", "%4$d"]
    a, b, c, d = (F.col(n) for n in "abcd")
    values = [(a + b) * c - d, d - (a - (b - c)), a * (b + (c + d) * 2), -(a + b) * -c, a + b * c, d]
    pick = lambda options: F.element_at(F.array(*options), (F.col("shape") + 1).cast("int"))
    stated = pick([v.cast("long") for v in values]) + F.when(F.col("off"), 5 + F.abs(pick([v.cast("long") for v in values]))).otherwise(0)
    text = F.concat(F.lit("По расчёту "), pick([F.format_string(s, "a", "b", "c", "d") for s in shapes]), F.lit(" = "), stated.cast("string"), F.lit(". Затем "), F.format_string("%d * %d - %d", "d", "c", "b"), F.lit(" за период."))
    rows = p.select("id", text.alias("text"))
    claims = rows.select("id", F.explode(expressions.equalities(F.col("text"))).alias("e")).select("id", "e.kind", "e.value", "e.stated", "e.ok")
    bare = rows.select("id", F.explode(expressions.bare_expressions(F.col("text"))).alias("e")).select("id", F.lit("bare").alias("kind"), "e.value", F.lit(None).cast("double").alias("stated"), F.lit(None).cast("boolean").alias("ok"))
    return claims.unionByName(bare)
