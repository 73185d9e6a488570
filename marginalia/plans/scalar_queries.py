"""Queries for the scalar functions, over inline cases and the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.functions import labels, numbers
from marginalia.plans.registry import query, read
from marginalia.sources import chunks

@query("""SELECT l_orderkey, l_linenumber, round(l_discount, 6) AS discount, round(l_extendedprice, 2) AS price FROM lineitem""")
def numbers_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values written as percent and as grouped decimals, read back by the parsers."""
    rows = read(spark, sf_dir, "lineitem")
    shown = rows.select("l_orderkey", "l_linenumber", F.concat(F.format_number(F.col("l_discount") * 100, 4), F.lit(" %")).alias("p"), numbers.formatted(F.col("l_extendedprice")).alias("m"))
    return shown.select("l_orderkey", "l_linenumber", F.round(numbers.with_unit(F.col("p"))["value"], 6).alias("discount"), F.round(numbers.plain_number(F.col("m")), 2).alias("price"))


@query("""SELECT c_custkey, [CAST(c_custkey AS DOUBLE), -1 * CAST(c_nationkey AS DOUBLE), CAST(c_nationkey AS DOUBLE) * 1000000, 12.5] AS found FROM customer""")
def numbers_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All numbers of a sentence in order, with signs and scale words."""
    text = F.concat(F.lit("клиент "), F.col("c_custkey").cast("string"), F.lit(" итог -"), F.col("c_nationkey").cast("string"), F.lit("; объём "), F.col("c_nationkey").cast("string"), F.lit(" млн и 12,5"))
    return read(spark, sf_dir, "customer").select("c_custkey", numbers.all_numbers(text).alias("found"))


@query("""WITH k AS (SELECT *, ['percent', 'count', 'money', 'ratio', 'unknown'][l_linenumber % 5 + 1] AS kind, ['', 'low', 'mid'][l_suppkey % 3 + 1] AS q, l_extendedprice * (1 + l_tax / 2) AS g, greatest(abs(l_extendedprice), abs(l_extendedprice * (1 + l_tax / 2))) AS m FROM lineitem),
t AS (SELECT *, CASE WHEN kind IN ('percent', 'ratio') THEN 0.03 WHEN kind = 'count' THEN 0.01 ELSE 0.02 END * CASE q WHEN 'low' THEN 1.8 WHEN 'mid' THEN 1.3 ELSE 1 END AS rel,
  CASE kind WHEN 'percent' THEN 1.2 WHEN 'count' THEN 1.0 WHEN 'ratio' THEN 0.02 WHEN 'unknown' THEN 0.8 ELSE CASE WHEN m >= 1e6 THEN 2000 WHEN m >= 1e5 THEN 200 WHEN m >= 1e4 THEN 20 WHEN m >= 1e3 THEN 5 ELSE 1 END END * CASE q WHEN 'low' THEN 2.5 WHEN 'mid' THEN 1.6 ELSE 1 END AS tol FROM k)
SELECT l_orderkey, l_linenumber, kind, abs(l_extendedprice - g) <= greatest(tol, rel * greatest(1, m)) AS ok FROM t""")
def adaptive_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem")
    kind = F.element_at(F.array(*map(F.lit, ["percent", "count", "money", "ratio", "unknown"])), F.col("l_linenumber") % 5 + 1)
    quality = F.element_at(F.array(*map(F.lit, ["", "low", "mid"])), (F.col("l_suppkey") % 3 + 1).cast("int"))
    ok = numbers.adaptive_close(F.col("l_extendedprice"), F.col("l_extendedprice") * (1 + F.col("l_tax") / 2), kind, quality)
    return rows.select("l_orderkey", "l_linenumber", kind.alias("kind"), ok.alias("ok"))


@query("""WITH o AS (SELECT unnest(['add', 'sub', 'rsub', 'mul', 'div', 'rdiv', 'pct', 'rpct', 'pctchg', 'rpctchg']) AS op)
SELECT op, p_partkey, round(CASE op WHEN 'add' THEN a + b WHEN 'sub' THEN a - b WHEN 'rsub' THEN b - a WHEN 'mul' THEN a * b WHEN 'div' THEN a / nullif(b, 0) WHEN 'rdiv' THEN b / nullif(a, 0) WHEN 'pct' THEN a / nullif(b, 0) * 100 WHEN 'rpct' THEN b / nullif(a, 0) * 100 WHEN 'pctchg' THEN a / nullif(b, 0) * 100 - 100 ELSE b / nullif(a, 0) * 100 - 100 END, 4) AS value
FROM o, (SELECT p_partkey, p_retailprice AS a, CAST(p_size % 10 AS DOUBLE) AS b FROM part WHERE p_partkey % 1 = 0)""".replace(" WHERE p_partkey % 1 = 0", ""))
def op_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every way to make a column of two others; null where the denominator is 0."""
    rows = read(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("a"), (F.col("p_size") % 10).cast("double").alias("b"))
    rows = rows.withColumn("op", F.explode(F.array(*map(F.lit, numbers.OPERATIONS))))
    return rows.select("op", "p_partkey", F.round(numbers.predicted(F.col("op"), F.col("a"), F.col("b")), 4).alias("value"))


NAMES = "SELECT * FROM (VALUES ('Итого выручка, тыс. руб.', 'выручка р'), ('Чистая прибыль (убыток)', 'чистая прибыль убыток'), ('2019 - 2020', '2019 2020'), ('  ', ''), ('Численность персонала на конец года, чел.', 'численность персонала конец года')) AS t(raw, name)"


@query(f"""WITH w AS (SELECT raw, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(trim(raw)), '[^\\p{{L}}\\p{{N}}_\\s-]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: x <> '' AND x NOT IN ('{"','".join(labels.STOP_WORDS)}')) AS words FROM (SELECT raw FROM ({NAMES}) UNION ALL SELECT p_name || ' (' || p_brand || '), на ' || p_type FROM part))
SELECT raw, array_to_string(words[1:8], ' ') AS name, array_to_string(words[1:8], ' ') <> '' AND NOT regexp_full_match(array_to_string(words[1:8], ' '), '[0-9\\s-]+') AS plausible FROM w""")
def measure_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" ("), "p_brand", F.lit("), на "), "p_type").alias("raw"))
    rows = spark.sql(NAMES).select("raw").unionByName(part).withColumn("name", labels.measure_name(F.col("raw")))
    return rows.withColumn("plausible", labels.plausible(F.col("name")))


@query(f"WITH {chunks.SQL} SELECT id, split_part(section_path, ' [row ', 1) AS base, coalesce(TRY_CAST(regexp_extract(section_path, '\\[row\\s+(\\d+)\\]', 1) AS BIGINT), 1000000000) AS row_index FROM chunks")
def table_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks.line_chunks(read(spark, sf_dir, "documents"))
    return rows.select("id", labels.base_path(F.col("section_path")).alias("base"), labels.row_index(F.col("section_path")).alias("row_index"))


@query(f"""WITH {chunks.SQL}, c AS (SELECT id, list_filter(list_transform(regexp_split_to_array(text, '\\s*\\|\\s*'), lambda x: trim(x)), lambda x: x <> '') AS cells FROM chunks WHERE contains(text, '|'))
SELECT id, len(cells) AS n, CASE WHEN len(cells) <= 4 THEN array_to_string(cells, ' ; ') ELSE array_to_string(cells[1:3], ' ; ') || ' ; ' || array_to_string(cells[4:], ' / ') END AS folded FROM c""")
def split_and_fold_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks.line_chunks(read(spark, sf_dir, "documents")).where(F.col("text").contains("|")).select("id", labels.cells(F.col("text")).alias("cells"))
    return rows.select("id", F.size("cells").alias("n"), F.array_join(labels.folded_cells(F.col("cells"), 4), " ; ").alias("folded"))


@query(f"WITH {chunks.SQL} SELECT id, 'anch-' || left(sha1(section_path || '|p=' || pos || '|t=' || left(text, 20)), 16) AS anchor, sha256(text) AS content, CASE WHEN regexp_matches(text, '[A-Za-z]{{3}}') AND NOT regexp_matches(text, '[А-Яа-яЁё]{{3}}') THEN 'en' ELSE 'ru' END AS guess FROM chunks")
def anchors_and_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks.line_chunks(read(spark, sf_dir, "documents"))
    return rows.select("id", labels.anchor_id(F.col("section_path"), F.col("pos"), F.substring("text", 1, 20)).alias("anchor"), F.sha2("text", 256).alias("content"), labels.language_guess(F.col("text")).alias("guess"))


@query("""WITH h AS (SELECT page_id, regexp_extract(html, '<h1[^>]*>([^<]*)', 1) AS h FROM pages), w AS (SELECT page_id, trim(h) AS t, len(regexp_split_to_array(trim(h), '\\s+')) AS n FROM h)
SELECT page_id, t AS heading, length(t) BETWEEN 3 AND 300 AND NOT regexp_matches(t, '[=÷×]') AND ((regexp_matches(t, '^\\d+(\\.\\d+)*\\.?\\s+\\S') AND n <= 25) OR (t = upper(t) AND regexp_matches(t, '\\p{Lu}') AND n <= 12 AND NOT ends_with(t, '.'))) AS is_heading FROM w""")
def page_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first heading of each page and whether it reads like one (no page begins with a known heading word)."""
    rows = read(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_extract("html", "<h1[^>]*>([^<]*)", 1)).alias("heading"))
    return rows.withColumn("is_heading", labels.is_heading(F.col("heading")))


@query(f"""WITH {chunks.SQL} SELECT id, trim(regexp_replace(replace(translate(regexp_replace(regexp_replace(section_path || ' ' || text, '^\\[[^\\]]*\\]\\s*', ''), '\\s*\\[row\\s+\\d+\\]', '', 'g'), '–—', '--'), ' | ', ' — '), '\\s+', ' ', 'g')) AS cleaned FROM chunks""")
def clean_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks.line_chunks(read(spark, sf_dir, "documents"))
    return rows.select("id", labels.clean_for_context(F.concat_ws(" ", "section_path", "text")).alias("cleaned"))
