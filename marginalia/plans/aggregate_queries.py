"""Queries for aggregation: counts, distinct bases, folds, runs, packing, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from marginalia.operators import aggregates as agg
from marginalia.plans.registry import query, read
from marginalia.sources import chunks


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.line_chunks(read(spark, sf_dir, "documents"))


@query(f"WITH {chunks.SQL} SELECT owner_id, element_type, count(*) AS n, count(DISTINCT doc_id) AS docs FROM chunks GROUP BY ALL")
def counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).groupBy("owner_id", "element_type").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query(f"""WITH {chunks.SQL}, b AS (SELECT DISTINCT owner_id, doc_id, split_part(section_path, ' [row ', 1) AS base FROM chunks WHERE element_type = 'table_row')
SELECT owner_id, doc_id, base, row_number() OVER (PARTITION BY owner_id, doc_id ORDER BY lower(base), base) AS place FROM b""")
def table_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct tables of a document by their path without the row tag."""
    rows = _chunks(spark, sf_dir).where("element_type = 'table_row'").select("owner_id", "doc_id", F.substring_index("section_path", " [row ", 1).alias("base")).distinct()
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("owner_id", "doc_id").orderBy(F.lower("base"), "base")))


@query(f"""WITH {chunks.SQL}, n AS (SELECT doc_id, element_type, lower(rtrim(regexp_replace(trim(text), '\\s+', ' ', 'g'), '.')) AS t FROM chunks)
SELECT doc_id, CASE WHEN count(*) FILTER (element_type = 'table_row') > 0 THEN count(*) FILTER (element_type = 'table_row')
       ELSE count(DISTINCT CASE WHEN element_type = 'text' AND length(t) >= 5 THEN t END) END AS sources FROM n GROUP BY doc_id""")
def count_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference rows of a document, or without any its distinct normalised paragraphs."""
    text = F.lower(F.rtrim(F.regexp_replace(F.trim("text"), r"\s+", " "), F.lit(".")))
    rows = _chunks(spark, sf_dir).select("doc_id", "element_type", text.alias("t"))
    direct = F.count_if(F.col("element_type") == "table_row")
    other = F.count_distinct(F.when((F.col("element_type") == "text") & (F.length("t") >= 5), F.col("t")))
    return rows.groupBy("doc_id").agg(direct.alias("direct"), other.alias("other")).select("doc_id", F.when(F.col("direct") > 0, F.col("direct")).otherwise(F.col("other")).alias("sources"))


@query("""WITH n AS (SELECT p_brand, p_partkey, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_brand, max(n) AS n, string_agg(p_name, '; ' ORDER BY k) AS shown, greatest(0, max(n) - 5) AS more FROM n WHERE k <= 5 GROUP BY p_brand""")
def listing_with_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, the first five names, and how many more there are."""
    w = Window.partitionBy("p_brand")
    rows = read(spark, sf_dir, "part").select("p_brand", "p_name", F.row_number().over(w.orderBy("p_partkey")).alias("k"), F.count("*").over(w).alias("n")).where("k <= 5")
    shown = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "p_name"))), lambda x: x["p_name"]), "; ")
    return rows.groupBy("p_brand").agg(F.max("n").alias("n"), shown.alias("shown")).withColumn("more", F.greatest(F.lit(0), F.col("n") - 5))


@query(f"""WITH {chunks.SQL} SELECT doc_id, section_path, min(id) AS id, min(pos) AS page, arg_min(text, (CASE WHEN element_type = 'heading' THEN 0 ELSE 1 END) * 100000000000 + id) AS text FROM chunks GROUP BY ALL""")
def fold_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a section path: first id, least page, and the text of its heading or else of its first chunk."""
    first = F.struct((F.col("element_type") != "heading").alias("rest"), "id")
    return _chunks(spark, sf_dir).groupBy("doc_id", "section_path").agg(F.min("id").alias("id"), F.min("pos").alias("page"), F.min_by("text", first).alias("text"))


@query("SELECT l_suppkey, list_sort(list(l_quantity))[count(*) // 2 + 1] AS upper_median, round(median(l_quantity), 6) AS middle FROM lineitem GROUP BY l_suppkey")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem")
    upper = agg.upper_medians(rows.select("l_suppkey", F.col("l_quantity").alias("upper_median")), ["l_suppkey"], ["upper_median"]).drop("n")
    return upper.join(rows.groupBy("l_suppkey").agg(F.round(F.percentile("l_quantity", 0.5), 6).alias("middle")), "l_suppkey")


@query("""WITH c AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, count(*) AS n, min(event_id) AS first_id FROM r GROUP BY user_id, run""")
def rle_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of consecutive events of one type, as sections are built from chunks of one path."""
    rows = agg.runs(read(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type")
    return rows.groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("""WITH b AS (SELECT source, doc_id, left(text, 7000) AS block FROM documents WHERE length(text) > 0),
s AS (SELECT *, sum(length(block)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS total FROM b)
SELECT source, count(*) AS blocks, CAST(max(total) AS BIGINT) AS chars, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM s WHERE total <= 24000 GROUP BY source""")
def merge_slot_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks cut to 7000 characters each, taken in order while they sum to at most 24000."""
    rows = read(spark, sf_dir, "documents").select("source", "doc_id", F.length(F.substring("text", 1, 7000)).alias("n")).where("n > 0")
    kept = agg.budget_prefix(rows, ["source"], ["doc_id"], F.col("n"), 24000, cut_last=False)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")), ",")
    return kept.groupBy("source").agg(F.count("*").alias("blocks"), F.sum("n").alias("chars"), ids.alias("ids"))


@query("""WITH RECURSIVE l AS (SELECT source, doc_id, least(length(text), 4000) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
f AS (SELECT source, doc_id, k, n AS used, 0 AS bin FROM l WHERE k = 1
  UNION ALL SELECT l.source, l.doc_id, l.k, CASE WHEN f.used > 0 AND f.used + l.n > 6000 THEN l.n ELSE f.used + l.n END, f.bin + CASE WHEN f.used > 0 AND f.used + l.n > 6000 THEN 1 ELSE 0 END FROM f JOIN l ON l.source = f.source AND l.k = f.k + 1)
SELECT source, doc_id, bin FROM f WHERE bin < 40""")
def group_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy packing of texts in order into at most 40 steps of 6000 characters (for each owner's list)."""
    rows = read(spark, sf_dir, "documents").select("source", "doc_id", F.least(F.length("text"), F.lit(4000)).alias("n"))
    # forty steps hold no more than their characters, so only such a prefix is gathered
    rows = agg.budget_prefix(rows, ["source"], ["doc_id"], F.col("n"), 40 * 6000, cut_last=False)
    lists = rows.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("doc_id", "n"))).alias("items"))
    put = lists.select("source", F.explode(F.arrays_zip(F.transform("items", lambda x: x["doc_id"]).alias("doc_id"), agg.bins(F.transform("items", lambda x: x["n"]), 6000, 40).alias("bin"))).alias("x"))
    return put.select("source", "x.doc_id", "x.bin").where("bin IS NOT NULL")


@query(f"""WITH {chunks.SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, element_type ORDER BY id) AS k FROM chunks),
p AS (SELECT doc_id, id, CASE element_type WHEN 'heading' THEN 0 WHEN 'text' THEN 1 ELSE 2 END AS part, left(text, 120) AS t FROM n WHERE (element_type = 'heading' AND k <= 20) OR (element_type = 'text' AND k <= 5) OR (element_type = 'table_row' AND k <= 3))
SELECT doc_id, string_agg(t, chr(10) ORDER BY part, id) AS overview, count(*) AS lines FROM p GROUP BY doc_id""")
def overview_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overview of a document: its headings, first paragraphs and sample rows, each under its quota."""
    w = Window.partitionBy("doc_id", "element_type").orderBy("id")
    kind = F.col("element_type")
    rows = _chunks(spark, sf_dir).withColumn("k", F.row_number().over(w)).where((kind == "heading") & (F.col("k") <= 20) | (kind == "text") & (F.col("k") <= 5) | (kind == "table_row") & (F.col("k") <= 3))
    part = F.when(kind == "heading", 0).when(kind == "text", 1).otherwise(2)
    items = F.sort_array(F.collect_list(F.struct(part.alias("part"), "id", F.substring("text", 1, 120).alias("t"))))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(items, lambda x: x["t"]), "\n").alias("overview"), F.count("*").alias("lines"))


@query("""SELECT source, count(*) AS docs, sum(n_chars) AS chars, max(CASE WHEN contains(text, ' | ') THEN 1 ELSE 0 END) = 1 AS has_tables, sum(length(trim(text))) < 500 AS scanned_like,
  count(*) FILTER (contains(text, ' | ')) AS with_tables FROM documents GROUP BY source""")
def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Existence and threshold tests over a group as aggregates."""
    tables = F.col("text").contains(" | ")
    return read(spark, sf_dir, "documents").groupBy("source").agg(
        F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.bool_or(tables).alias("has_tables"), (F.sum(F.length(F.trim("text"))) < 500).alias("scanned_like"), F.count_if(tables).alias("with_tables")
    )


@query("""WITH RECURSIVE p AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE doc_id % 1 = 0), f AS (
  SELECT doc_id, 1 AS k, l, l[1] AS open, CAST([] AS VARCHAR[]) AS done FROM p
  UNION ALL SELECT doc_id, k + 1, l,
    CASE WHEN length(open) + length(l[k + 1]) + 1 <= 1800 THEN CASE WHEN open = '' THEN l[k + 1] ELSE open || chr(10) || chr(10) || l[k + 1] END ELSE l[k + 1] END,
    CASE WHEN length(open) + length(l[k + 1]) + 1 <= 1800 OR open = '' THEN done ELSE list_append(done, open) END FROM f WHERE k < len(l)),
e AS (SELECT doc_id, CASE WHEN open = '' THEN done ELSE list_append(done, open) END AS c FROM f WHERE k = len(l))
SELECT doc_id, len(c) AS n_chunks, list_sum(list_transform(c, lambda x: length(x))) AS chars, list_max(list_transform(c, lambda x: length(x))) AS longest FROM e""".replace(" WHERE doc_id % 1 = 0", ""))
def chunk_greedy_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs packed greedily to chunks of 1800 characters; one over the limit is a chunk of its own."""
    packed = read(spark, sf_dir, "documents").select("doc_id", chunks.pack(F.split("text", "\n"), 1800).alias("c"))
    sizes = F.transform("c", lambda x: F.length(x))
    return packed.select("doc_id", F.size("c").alias("n_chunks"), F.aggregate(sizes, F.lit(0), lambda a, x: a + x).cast("bigint").alias("chars"), F.array_max(sizes).alias("longest"))
