"""Queries for evidence: candidates for calculation, samples, cut texts, fuzzy captions, limits, chart encodings, intents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from marginalia.functions import texts
from marginalia.operators import candidates
from marginalia.plans.registry import query, read
from marginalia.sources import chunks


@query(f"""WITH {chunks.SQL}, c AS (SELECT doc_id, id, text FROM chunks WHERE element_type IN ('text', 'table_row') AND regexp_matches(text, '[0-9]') AND NOT regexp_matches(text, '(^|[^0-9])(19|20)[0-9]{{2}}([^0-9]|$)') OR contains(text, '%'))
SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY id) AS place FROM c QUALIFY place <= 140""")
def calc_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that may hold evidence for a calculation: numbers that are no years, or a percent sign; the first 140 of a document."""
    rows = chunks.line_chunks(read(spark, sf_dir, "documents"))
    kind, text = F.col("element_type"), F.col("text")
    fits = kind.isin("text", "table_row") & text.rlike("[0-9]") & ~text.rlike("(^|[^0-9])(19|20)[0-9]{2}([^0-9]|$)") | text.contains("%")
    return rows.where(fits).select("doc_id", "id", F.row_number().over(Window.partitionBy("doc_id").orderBy("id")).alias("place")).where("place <= 140")


@query()
def cut_for_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut at paragraphs, lines, sentences or words into pieces of 3500 characters. Not in SQL: each cut depends on the one before."""
    cut = texts.pieces(3500)
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(cut(F.col("text"))).alias("piece_no", "piece"))


@query()
def fuzzy_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most alike names of each typed caption. Not in SQL: the likeness is by longest common blocks."""
    names = read(spark, sf_dir, "part").select("p_name").distinct()
    asked = spark.createDataFrame([("lavender part",), ("Azure",)], "typed string")
    pairs = names.join(F.broadcast(asked), F.lit(True)).withColumn("ratio", F.round(texts.likeness(F.col("typed"), F.col("p_name")), 6))  # two captions
    return pairs.withColumn("place", F.row_number().over(Window.partitionBy("typed").orderBy(F.desc("ratio"), "p_name"))).where("place <= 3")


@query("""WITH RECURSIVE l AS (SELECT source, list(length(text) ORDER BY doc_id) AS ls FROM documents GROUP BY source),
f AS (SELECT source, ls, least(len(ls), 500) AS n, 0 AS k FROM l UNION ALL SELECT source, ls, CASE WHEN n > 1 AND list_sum(ls[1:n]) > 20000 THEN greatest(1, n - greatest(5, n // 10)) ELSE n END, k + 1 FROM f WHERE k < 80)
SELECT source, CAST(n AS INT) AS shown, len(ls) AS total_rows, n < len(ls) AS truncated FROM f WHERE k = 80""")
def rows_and_chars_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of a table fit: 500 at most, then fewer until they have 20000 characters."""
    docs = read(spark, sf_dir, "documents").select("source", "doc_id", F.length("text").alias("n"))
    first = docs.withColumn("_k", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("_k <= 500")
    shown = first.groupBy("source").agg(texts.within(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "n"))), lambda x: x["n"]), 500, 20000).alias("shown"))
    total = docs.groupBy("source").agg(F.count("*").cast("int").alias("total_rows"))
    return shown.join(total, "source").withColumn("truncated", F.col("shown") < F.col("total_rows"))


def _fits_sql(weak: bool) -> str:
    low, money = "lower(text)", "({})".format(" OR ".join(f"contains(lower(text), '{s}')" for s in candidates.MONEY))
    shares = "" if weak else " OR contains({0}, '%') OR {1}".format(low, " OR ".join(f"contains(lower(text), '{s}')" for s in candidates.SHARES))
    numbers = f"list_transform(regexp_extract_all({low}, '\\d+(?:[.,]\\d+)?'), lambda n: CAST(replace(n, ',', '.') AS DOUBLE))"
    return f"((regexp_matches({low}, '[0-9]') OR {money}) AND ({money} OR regexp_matches({low}, '\\d+(?:[.,]\\d+)?\\s*[-+−*/×=]\\s*\\d+(?:[.,]\\d+)?'){shares} OR len(list_filter({numbers}, lambda v: NOT (round_even(v, 0) BETWEEN 1900 AND 2100 OR abs(v) <= 200))) > 0))"


@query(f"""WITH {chunks.SQL}, c AS (SELECT doc_id, id, element_type, section_path, text FROM chunks WHERE element_type IN ('text', 'table_row') AND {_fits_sql(False)} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY id) <= 140),
s AS (SELECT doc_id, id, 'paragraph' AS element_type, section_path, text FROM chunks WHERE element_type = 'heading' AND doc_id NOT IN (SELECT doc_id FROM c GROUP BY doc_id HAVING count(*) >= 5) AND {_fits_sql(True)} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY id) <= 220),
e AS (SELECT *, 0 AS from_sections FROM c UNION ALL SELECT *, 1 FROM s)
SELECT doc_id, id, element_type, from_sections FROM e QUALIFY row_number() OVER (PARTITION BY doc_id, element_type, section_path, left(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 400) ORDER BY from_sections, id) = 1""")
def calc_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that may hold evidence for a calculation, and headings as sections where a document has fewer than five."""
    rows = chunks.line_chunks(read(spark, sf_dir, "documents")).select("doc_id", "id", "element_type", "section_path", "text")
    sections = rows.where("element_type = 'heading'").withColumn("element_type", F.lit(None).cast("string"))
    return candidates.with_sections(candidates.of_chunks(rows, ["doc_id"]), sections, ["doc_id"]).select("doc_id", "id", "element_type", "from_sections")
