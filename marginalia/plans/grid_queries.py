"""Queries for grids as a user has them: text cells, from which header, years, totals and rules are found. Grids are made of the driver's tables, with planted faults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.functions import labels, numbers, signals
from marginalia.operators import checks, grids
from marginalia.plans.registry import query, read

#: A table for each nation: segments by two years, their difference (wrong in every fifth), growth (off for one segment) and a total (wrong in every ninth).
GRID_SQL = """y AS (SELECT c_nationkey AS t, c_mktsegment AS s, CAST(floor(sum(CASE WHEN year(o_orderdate) = 1994 THEN o_totalprice ELSE 0 END) + 0.005) AS BIGINT) AS y1, CAST(floor(sum(CASE WHEN year(o_orderdate) = 1995 THEN o_totalprice ELSE 0 END) + 0.005) AS BIGINT) AS y2 FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
g AS (SELECT t, s, row_number() OVER (PARTITION BY t ORDER BY s) - 1 + CASE WHEN t % 2 = 1 THEN 2 ELSE 1 END AS r, CAST(y1 AS DOUBLE) AS y1, CAST(y2 AS DOUBLE) AS y2, CAST(y2 - y1 + CASE WHEN t % 5 = 1 THEN 5000 ELSE 0 END AS DOUBLE) AS d,
  CASE WHEN y1 > 0 THEN CAST(floor(100.0 * y2 / y1) - CASE WHEN t % 2 = 0 THEN 100 ELSE 0 END + CASE WHEN s = 'BUILDING' THEN 7 ELSE 0 END AS DOUBLE) END AS p FROM y),
cells AS (SELECT t, s, r, unnest([1, 2, 3, 4]) AS c, unnest([y1, y2, d, p]) AS v FROM g)"""


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    # half a hundredth keeps whole sums from falling below themselves, whatever the order of adding
    sums = [F.floor(F.sum(F.when(F.year("o_orderdate") == y, F.col("o_totalprice")).otherwise(0.0)) + 0.005).alias(n) for y, n in ((1994, "y1"), (1995, "y2"))]
    rows = both.groupBy(F.col("c_nationkey").cast("long").alias("table_id"), F.col("c_mktsegment").alias("s")).agg(*sums)
    odd = F.col("table_id") % 2 == 1
    growth = F.when(F.col("y1") > 0, F.floor(F.lit(100.0) * F.col("y2") / F.col("y1")) - F.when(odd, 0).otherwise(100) + F.when(F.col("s") == "BUILDING", 7).otherwise(0))
    rows = rows.withColumn("d", F.col("y2") - F.col("y1") + F.when(F.col("table_id") % 5 == 1, 5000).otherwise(0)).withColumn("p", growth)
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    # a table's rows in order: the header in one or in two rows, the segments, the total
    data = rows.select("table_id", F.concat(F.lit("2"), "s").alias("k"), F.array("s", *map(shown, ["y1", "y2", "d", "p"])).alias("cells"))
    wrong = F.when(F.col("table_id") % 9 == 0, 1.1).otherwise(1.0)
    total = rows.groupBy("table_id").agg(*[F.sum(c).alias(c) for c in ("y1", "y2", "d")])
    total = total.select("table_id", F.lit("3").alias("k"), F.array(F.lit("Итого"), *[F.floor(F.col(c) * wrong).cast("string") for c in ("y1", "y2", "d")], F.lit("")).alias("cells"))
    one = rows.select("table_id").distinct()
    head = one.select("table_id", F.lit("1").alias("k"), F.lit(["Сегмент", "1994, тыс. руб.", "1995, тыс. руб.", "Отклонение", "Темп роста, %"]).alias("cells"))
    above = one.where("table_id % 2 = 1").select("table_id", F.lit("0").alias("k"), F.lit(["Показатели", "Годы", "", "", ""]).alias("cells"))
    every = data.unionByName(total).unionByName(head).unionByName(above)
    from pyspark.sql import Window

    return every.select("table_id", (F.row_number().over(Window.partitionBy("table_id").orderBy("k")) - 1).alias("row_idx"), "cells")  # at most 8 rows a table


TOTALS_SQL = """SELECT 'table_total' AS kind, CAST(t AS BIGINT) AS table_id, CAST(c AS VARCHAR) AS place, abs(s - g) <= greatest(1e-6, 3e-3 * greatest(1, abs(s), abs(g))) AS ok, s AS expected, g AS given
FROM (SELECT t, c, sum(v) AS s, floor(sum(v) * CASE WHEN t % 9 = 0 THEN 1.1 ELSE 1.0 END) AS g FROM cells WHERE c < 4 GROUP BY t, c HAVING count(v) >= greatest(2, floor(count(*) * 0.5)))"""
GROWTH_SQL = """SELECT 'table_delta' AS kind, CAST(t AS BIGINT) AS table_id, CAST(r AS VARCHAR) AS place, abs(y2 - y1 - d) <= greatest(CASE WHEN greatest(y1, y2) < 50 THEN 0.5 ELSE 1.0 END, 0.01 * greatest(1, abs(y2 - y1), abs(d))) AS ok, y2 - y1 AS expected, d AS given FROM g
UNION ALL SELECT 'table_percent', CAST(t AS BIGINT), CAST(r AS VARCHAR), abs(e - p) <= 1.2, round(e, 4), p FROM (SELECT *, y2 / y1 * 100 - CASE WHEN ma <= mb THEN 0 ELSE 100 END AS e FROM g JOIN (
  SELECT t, count(*) AS n, list_sort(list(abs(y2 / y1 * 100 - p)))[count(*) // 2 + 1] AS ma, list_sort(list(abs(y2 / y1 * 100 - 100 - p)))[count(*) // 2 + 1] AS mb FROM g WHERE p IS NOT NULL GROUP BY t) USING (t) WHERE p IS NOT NULL AND n >= 3)"""
RULES_SQL = """told AS (SELECT t, c FROM cells GROUP BY t, c HAVING count(*) FILTER (v IS NOT NULL) + CASE WHEN c < 4 THEN 1 ELSE 0 END >= 3), able AS (SELECT t FROM told WHERE c >= 3 GROUP BY t HAVING count(*) >= 2),
n AS (SELECT cells.* FROM cells JOIN told USING (t, c) JOIN able USING (t)),
tries AS (SELECT z.t, z.r, z.c AS target, a.c AS a, b.c AS b, z.v AS given, a.v AS x, b.v AS w, op, z.c = 4 AS pc FROM n z JOIN n a ON a.t = z.t AND a.r = z.r AND a.c <> z.c JOIN n b ON b.t = z.t AND b.r = z.r AND b.c <> z.c AND b.c > a.c,
  (SELECT unnest(['add', 'sub', 'rsub', 'mul', 'div', 'rdiv', 'pct', 'rpct', 'pctchg', 'rpctchg']) AS op) WHERE z.c >= 3 AND (z.c = 4 OR NOT contains(op, 'pct'))),
e AS (SELECT *, CASE op WHEN 'add' THEN x + w WHEN 'sub' THEN x - w WHEN 'rsub' THEN w - x WHEN 'mul' THEN x * w WHEN 'div' THEN x / nullif(w, 0) WHEN 'rdiv' THEN w / nullif(x, 0) WHEN 'pct' THEN x / nullif(w, 0) * 100 WHEN 'rpct' THEN w / nullif(x, 0) * 100 WHEN 'pctchg' THEN x / nullif(w, 0) * 100 - 100 ELSE w / nullif(x, 0) * 100 - 100 END AS expected FROM tries),
k AS (SELECT *, abs(expected - given) <= greatest(CASE WHEN pc THEN 1.2 ELSE 0.8 END, CASE WHEN pc THEN 0.03 ELSE 0.02 END * greatest(1, abs(expected), abs(given))) AS good FROM e WHERE expected IS NOT NULL AND given IS NOT NULL),
rules AS (SELECT t, target, a, b, op, count(*) AS n, count(*) FILTER (good) AS hits, round(avg(abs(expected - given)), 6) AS err FROM k GROUP BY ALL HAVING count(*) >= 5 AND count(*) FILTER (good) >= count(*) * 0.72),
best AS (SELECT * FROM rules QUALIFY row_number() OVER (PARTITION BY t, target ORDER BY hits / n DESC, hits DESC, err, a, b, op) = 1)"""
FACTS_SQL = "f AS (SELECT lower(s) AS label, 1993 + c AS year, 'money' AS kind, v * 1000 AS value, 1000.0::DOUBLE AS scale, t FROM cells WHERE c <= 2)"
CROSS_SQL = "m AS (SELECT label, year, count(DISTINCT t) AS tables, list_sort(list(value))[count(*) // 2 + 1] AS median FROM f GROUP BY ALL)"


@query(f"WITH {GRID_SQL} {TOTALS_SQL}")
def grid_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total rows found in grids, and their columns against the rows above."""
    return grids.totals_found(grids.cells_of(_grid(spark, sf_dir)))


@query(f"WITH {GRID_SQL} {GROWTH_SQL}")
def grid_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year columns, differences and rates found by their headers, and checked."""
    return grids.growth_found(grids.cells_of(_grid(spark, sf_dir)))


@query(f"WITH {GRID_SQL}, {RULES_SQL} SELECT CAST(t AS BIGINT) AS table_id, target, a, b, op, n, hits, coalesce((SELECT string_agg(CAST(r AS VARCHAR), ',' ORDER BY r) FROM k WHERE k.t = best.t AND k.target = best.target AND k.a = best.a AND k.b = best.b AND k.op = best.op AND NOT good), '') AS exceptions FROM best")
def grid_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules between columns of grids: of ten operations, those of percentages for columns of rates."""
    return grids.formulas_found(grids.cells_of(_grid(spark, sf_dir)))


@query(f"WITH {GRID_SQL}, {FACTS_SQL} SELECT label, year, kind, value, scale, CAST(t AS BIGINT) AS table_id FROM f")
def grid_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts (label, year, value) of grids, scaled as their headers say."""
    grid = _grid(spark, sf_dir)
    return grids.facts(grid, grids.cells_of(grid)).where("label <> ''")


@query(f"""WITH {GRID_SQL}, {RULES_SQL}, {FACTS_SQL}, {CROSS_SQL}, v AS (SELECT t, label, year, value, lag(value) OVER (PARTITION BY t, label ORDER BY year) AS before FROM f),
every AS ({TOTALS_SQL} UNION ALL {GROWTH_SQL}
UNION ALL SELECT 'table_infer', CAST(k.t AS BIGINT), CAST(k.r AS VARCHAR), false, NULL, NULL FROM k JOIN best USING (t, target, a, b, op) WHERE NOT good
UNION ALL SELECT 'cross_table', CAST(t AS BIGINT), label || '@' || year, abs(median - value) <= greatest(2000.0, 0.005 * greatest(1, abs(median), abs(value))), round(median, 2), round(value, 2) FROM f JOIN m USING (label, year) WHERE tables >= 2
UNION ALL SELECT 'trend', CAST(t AS BIGINT), label || '@' || year, true, round(abs(value / nullif(before, 0)), 4), round(value, 4) FROM v WHERE abs(value / nullif(before, 0)) > 30)
SELECT kind, table_id, place, ok, expected, given FROM every""")
def calc_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks of all grids in one form, as a question about the correctness of numbers is answered."""
    return grids.report(_grid(spark, sf_dir))


PARTS_SQL = """c AS (SELECT c_nationkey AS t, c_mktsegment AS s, count(*) AS n, count(*) FILTER (c_acctbal < 2000) AS a, count(*) FILTER (c_acctbal >= 2000 AND c_acctbal < 6000) AS b FROM customer GROUP BY ALL),
w AS (SELECT t, sum(n) AS n, [sum(a), sum(b), sum(n - a - b)] AS counts FROM c WHERE n >= 2 GROUP BY t HAVING count(*) >= 2),
z AS (SELECT t, n, unnest([0, 1, 2]) AS pos, unnest(counts) AS k FROM w),
q AS (SELECT t, pos, n, 100.0 * k / n AS expected, floor(100.0 * k / n) + CASE WHEN t % 3 = 0 AND pos = 0 THEN 5 ELSE 0 END AS given, 100.0 / n AS step FROM z)"""


@query(f"""WITH {PARTS_SQL} SELECT 'subgroup_total' AS kind, CAST(t AS BIGINT) AS table_id, CAST(pos AS VARCHAR) AS place, abs(expected - given) <= greatest(0.6, 0.4 * step) AND abs(given - round_even(given / step, 0) * step) <= greatest(0.6, 0.4 * step) AS ok, round(CAST(expected AS DOUBLE), 4) AS expected, CAST(given AS DOUBLE) AS given FROM q""")
def subgroup_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentages of subgroups in text cells, rebuilt as counts and added up, against what is stated of the whole, some of it wrong; the size of a row's group is chosen by its label."""
    c = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("table_id"), F.col("c_mktsegment").alias("s")).agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 2000).alias("a"), F.count_if((F.col("c_acctbal") >= 2000) & (F.col("c_acctbal") < 6000)).alias("b"))
    c = c.where("n >= 2").withColumn("r", F.col("n") - F.col("a") - F.col("b"))
    shares = [F.concat(F.format_string("%.3f", 100.0 * F.col(k) / F.col("n")), F.lit("%")) for k in ("a", "b", "r")]
    grid = c.select("table_id", F.dense_rank().over(_by("table_id", "s")).alias("row_idx"), F.array(F.concat(F.lit("Группа "), "s"), *shares).alias("cells"))
    grid = grid.unionByName(c.select("table_id").distinct().select("table_id", F.lit(0).alias("row_idx"), F.lit(["Группа", "низкий, %", "средний, %", "высокий, %"]).alias("cells")))
    whole = c.groupBy("table_id").agg(F.sum("n").alias("total"), *[F.sum(k).alias(k) for k in ("a", "b", "r")], F.sort_array(F.collect_list(F.struct(F.lower("s").alias("stem"), "n"))).alias("groups"))
    stated = whole.select("table_id", "total", F.array(*[F.floor(100.0 * F.col(k) / F.col("total")) + (F.when(F.col("table_id") % 3 == 0, 5).otherwise(0) if k == "a" else 0) for k in ("a", "b", "r")]).cast("array<double>").alias("ps"))
    rows = grids.percent_rows(grids.cells_of(grid)).join(whole.select("table_id", "total", "groups"), "table_id")
    return grids.subgroup_totals(rows.select("table_id", "row_idx", "ps", grids.denominator_of(F.col("label"), F.col("groups"), F.col("total")).alias("n")), stated)


def _by(*columns: str):
    from pyspark.sql import Window

    return Window.partitionBy(columns[0]).orderBy(*columns[1:])


@query("""WITH p AS (SELECT p_partkey AS id, p_size AS n, p_partkey % 9 AS k FROM part)
SELECT id, k IN (0, 5) AS formula, k = 1 AS contents, k IN (2, 3) AS posting, CASE k WHEN 4 THEN 'center' END IS NOT NULL AND k = 4 AS title, k IN (0, 2, 7, 8) AS total_row FROM p""")
def line_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lines of nine makes are: formulas, lines of a table of contents, ledger postings, titles, total rows."""
    makes = ["Итого К1 = {n} руб.", "Введение ..... {n}", "всего по дебету счета {n}", "Корреспонденция счетов: 62.0{n}", "Состав персонала {n}", "ряд: a ÷ {n}", "обычный текст {n}", "сумма по строке {n}", "В итоге получено {n}"]
    line = F.replace(F.element_at(F.lit(makes), (F.col("p_partkey") % 9 + 1).cast("int")), F.lit("{n}"), F.col("p_size").cast("string"))
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), line.alias("line"))
    title = signals.is_title_candidate(F.col("line"), F.when(F.col("id") % 9 == 4, "center"), F.lit(False), labels.caption(F.col("line"))["kind"].isNotNull())
    return rows.select("id", signals.is_formula(F.col("line")).alias("formula"), signals.is_contents_line(F.col("line")).alias("contents"), signals.is_posting(F.col("line")).alias("posting"), title.alias("title"), signals.is_total_row(F.split("line", " ")).alias("total_row"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber % 4 AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE k WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN l_partkey % 300 + 1850 BETWEEN 1900 AND 2100 ELSE false END AS identifier, k = 0 AS account, CASE k WHEN 3 THEN NULL WHEN 0 THEN NULL WHEN 1 THEN l_partkey + 0.5 ELSE l_partkey % 300 + 1850 END::DOUBLE AS value FROM l""")
def token_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that are codes of accounts or years and no quantities, and decimals with spaces, commas and percent signs."""
    k = F.col("l_linenumber") % 4
    token = F.when(k == 0, F.concat((F.col("l_partkey") % 90 + 10).cast("string"), F.lit("."), (F.col("l_suppkey") % 9).cast("string"), F.lit("."), F.lit("1"))).when(k == 1, F.concat(F.col("l_partkey").cast("string"), F.lit(",5 %"))).when(k == 2, (F.col("l_partkey") % 300 + 1850).cast("string")).otherwise(F.lit("abc"))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", token.alias("token"))
    return rows.select("l_orderkey", "l_linenumber", signals.is_identifier(F.col("token")).alias("identifier"), signals.is_account_code(F.col("token")).alias("account"), numbers.decimal_of(F.col("token")).cast("double").alias("value"))


@query("""WITH p AS (SELECT p_partkey, p_size, [p_name, p_brand] AS a, [p_type, CAST(p_size AS VARCHAR)] AS b FROM part)
SELECT p_partkey, unnest([0, 1]) AS row_idx, unnest([array_to_string(a, '|'), array_to_string(b, '|')]) AS cells, unnest([false, false]) AS is_total FROM p
UNION ALL SELECT p_partkey, 2, 'Итого|' || p_size, true FROM p WHERE p_partkey % 2 = 0""")
def grids_from_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tables that come as a list of lists or as tab-separated text with blank lines."""
    p = read(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    listed = F.to_json(F.struct(F.array(F.array("p_name", "p_brand"), F.array("p_type", size), F.array(F.lit("Итого"), size)).alias("table_grid")))
    typed = F.to_json(F.struct(F.concat(F.concat_ws("\t", "p_name", "p_brand"), F.lit("\n \t \n"), F.concat_ws("\t", F.concat(F.lit(" "), "p_type"), size), F.lit("\n")).alias("table_tsv")))
    rows = p.select("p_partkey", F.posexplode(signals.grid_of(F.when(F.col("p_partkey") % 2 == 0, listed).otherwise(typed))).alias("row_idx", "cells"))
    return rows.select("p_partkey", "row_idx", F.array_join("cells", "|").alias("cells"), signals.is_total_row(F.col("cells")).alias("is_total"))


UNITS_SQL = "[" + ", ".join(f"['{way}', '{unit}']" for unit, ways in numbers.UNITS.items() for way in ways) + "]"


@query(f"""WITH u AS (SELECT list({{'raw': x[1], 'unit': x[2]}}) AS u FROM (SELECT unnest({UNITS_SQL}) AS x))
SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN lower(p_brand) ELSE u[p_partkey % len(u) + 1].unit END AS unit FROM part, u""")
def unit_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every way to write a unit, in either case and with spaces; others are lower-cased."""
    ways = [way for ws in numbers.UNITS.values() for way in ws]
    raw = F.element_at(F.lit(ways), (F.col("p_partkey") % len(ways) + 1).cast("int"))
    shown = F.when(F.col("p_partkey") % 7 == 0, F.col("p_brand")).when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), F.upper(raw), F.lit("  "))).otherwise(raw)
    return read(spark, sf_dir, "part").select("p_partkey", numbers.unit_of(shown).alias("unit"))


@query("""WITH e AS (SELECT o_orderkey, o_totalprice, [o_totalprice, -1.0 * o_totalprice, 150.0, 1899.5, 2100.5, CAST(o_orderkey % 3000 AS DOUBLE)][o_orderkey % 6 + 1] AS x FROM orders)
SELECT o_orderkey, x, round_even(x, 0) BETWEEN 1900 AND 2100 AS year, abs(x) <= 200 AS small FROM e""")
def years_and_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that look like years (rounded to even) or like small indexes."""
    x = F.element_at(F.array(F.col("o_totalprice"), -F.col("o_totalprice"), F.lit(150.0), F.lit(1899.5), F.lit(2100.5), (F.col("o_orderkey") % 3000).cast("double")), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", x.alias("x"), numbers.is_year(x).alias("year"), numbers.is_small_index(x).alias("small"))


@query("""WITH l AS (SELECT l_orderkey, count(*) AS rows, round(avg(CASE WHEN l_quantity > 20 THEN 1.0 ELSE 0 END + 1.0) / 2, 4) AS filled, round(avg(CASE WHEN l_quantity > 20 THEN 1.0 ELSE 0 END) / 2, 4) AS numeric FROM lineitem GROUP BY 1)
SELECT l_orderkey, filled, numeric, CASE WHEN filled < 0.25 OR numeric < 0.2 THEN 'low' WHEN filled < 0.45 OR numeric < 0.35 THEN 'mid' ELSE 'high' END AS quality FROM l""")
def recognition_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of recognised tables, from how many of their text cells are filled and how many are numbers."""
    from marginalia.operators import tables

    cells = F.array(F.col("l_returnflag"), F.when(F.col("l_quantity") > 20, F.col("l_quantity").cast("string")).otherwise(""))
    return tables.recognised(read(spark, sf_dir, "lineitem").select("l_orderkey", cells.alias("cells")), ["l_orderkey"])
