"""Queries for the joins: as-of, band, outer, theta, exact-else-prefix, ordered union."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from marginalia.operators import joins
from marginalia.plans.registry import query, read
from marginalia.sources import chunks


@query("SELECT d.doc_id, d.source, l.quality, l.toxic, row_number() OVER (PARTITION BY d.source ORDER BY l.quality ASC NULLS FIRST, d.doc_id) AS place FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_join_nulls_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items left-joined with their analysis, listed with missing values first."""
    both = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return both.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(F.asc_nulls_first("quality"), "doc_id")))


@query("SELECT source, min_by(doc_id, doc_id) AS doc_id, arg_min(quality, doc_id) AS quality FROM documents JOIN labels USING (doc_id) GROUP BY source")
def inner_join_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items joined with their analysis, the first of each owner."""
    both = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id")
    return both.groupBy("source").agg(F.min("doc_id").alias("doc_id"), F.min_by("quality", "doc_id").alias("quality"))


@query("""SELECT event_id, user_id, event_type, value,
  last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER w AS prev_event_id,
  last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER w AS prev_value
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def asof_prev_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last purchase strictly before each event of a user."""
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return joins.as_of(rows, ["user_id"], "event_id", F.col("event_type") == "purchase", ["event_id", "value"], strict=True)


@query(f"""WITH {chunks.SQL}
SELECT id, last_value(CASE WHEN element_type = 'heading' THEN text END IGNORE NULLS) OVER w AS head_text,
       last_value(CASE WHEN element_type = 'heading' THEN id END IGNORE NULLS) OVER w AS head_id
FROM chunks WINDOW w AS (PARTITION BY owner_id, doc_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def asof_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heading at or above each chunk."""
    rows = chunks.line_chunks(read(spark, sf_dir, "documents"))
    found = joins.as_of(rows, ["owner_id", "doc_id"], "id", F.col("element_type") == "heading", ["text", "id"], prefix="head_")
    return found.select("id", "head_text", "head_id")


@query("SELECT a.event_id AS anchor_id, b.event_id AS event_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_id BETWEEN a.event_id - 300 AND a.event_id + 300 WHERE a.event_type = 'purchase'")
def neighbours_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the same user whose ids lie within 300 of a purchase's."""
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    anchors = rows.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("anchor_id"))
    return joins.band(anchors, rows.select("user_id", "event_id"), ["user_id"], "anchor_id", "event_id", 300, 300).select("anchor_id", "event_id")


MENTIONS = "SELECT * FROM (VALUES (1, 'figure', '1'), (2, 'figure', '2'), (3, 'table', '2.1'), (4, 'table', '3'), (5, 'part', '12')) AS t(label_id, kind, label)"
MENTION_TEXTS = "SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 'see figure ' || p_size || ' below' WHEN 1 THEN 'Table 2.1 shows ' || p_name WHEN 2 THEN 'as in TABLE 3, ' || p_brand WHEN 3 THEN p_name || ' part 12' ELSE p_type END AS text FROM part"


@query(f"""WITH m AS ({MENTIONS}), t AS ({MENTION_TEXTS}), hits AS (
  SELECT label_id, id, row_number() OVER (PARTITION BY label_id ORDER BY id) AS n FROM t JOIN m ON regexp_matches(lower(text), kind || '\\s+' || replace(label, '.', '[.]') || '([^0-9.]|[.]?$|[.][^0-9])'))
SELECT label_id, id, n FROM hits WHERE n <= 4""")
def mentions_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four texts that mention each label, by one extraction of all references and an equality join."""
    labels = spark.sql(MENTIONS)
    texts = spark.sql(MENTION_TEXTS.replace("FROM part", "FROM {part}"), part=read(spark, sf_dir, "part"))
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\b((?:figure|table|part)\s+[0-9]+(?:\.[0-9]+)*)"), F.lit(1))
    posts = texts.select("id", F.explode(F.array_distinct(found)).alias("ref"))
    posts = posts.select("id", F.split("ref", r"\s+").alias("ref")).select("id", F.col("ref")[0].alias("kind"), F.col("ref")[1].alias("label"))
    hits = posts.join(F.broadcast(labels), ["kind", "label"])  # the labels are five rows
    n = F.row_number().over(Window.partitionBy("label_id").orderBy("id"))
    return hits.select("label_id", "id", n.alias("n")).where("n <= 4")


NUMBERS = "SELECT * FROM (VALUES ('1'), ('12'), ('7.3'), ('99'), ('25')) AS t(asked)"


@query(f"""WITH q AS ({NUMBERS}), n AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS VARCHAR) ELSE p_size || '.' || (p_partkey % 7) END AS number FROM part),
hits AS (SELECT asked, p_partkey, number, number = asked AS exact FROM q JOIN n ON number = asked OR starts_with(number, asked || '.'))
SELECT asked, p_partkey, number, exact FROM hits QUALIFY exact OR NOT bool_or(exact) OVER (PARTITION BY asked)""")
def number_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a number, or of its sub-numbers where the number itself is missing."""
    part = read(spark, sf_dir, "part")
    number = F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("string")).otherwise(F.concat_ws(".", F.col("p_size"), F.col("p_partkey") % 7))
    named = part.select("p_partkey", number.alias("number"))
    return joins.exact_else_prefix(spark.sql(NUMBERS), named, "asked", "number").select("asked", "p_partkey", "number", "exact")


@query(f"""WITH {chunks.SQL}, c AS (SELECT doc_id, pos FROM chunks WHERE element_type = 'table_row'), a AS (SELECT doc_id, pos FROM chunks WHERE element_type = 'heading'),
near AS (SELECT a.doc_id, a.pos, c.pos AS caption_pos, row_number() OVER (PARTITION BY a.doc_id, a.pos ORDER BY abs(c.pos - a.pos), c.pos < a.pos) AS n FROM a JOIN c ON a.doc_id = c.doc_id AND c.pos BETWEEN a.pos - 3 AND a.pos + 3 AND c.pos <> a.pos)
SELECT doc_id, pos, caption_pos FROM near WHERE n = 1""")
def nearest_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest row with cells within three lines of a heading; at equal distance the one below."""
    rows = chunks.line_chunks(read(spark, sf_dir, "documents"))
    anchors = rows.where("element_type = 'heading'").select("doc_id", "pos")
    captions = rows.where("element_type = 'table_row'").select("doc_id", F.col("pos").alias("caption_pos"))
    near = joins.band(anchors, captions, ["doc_id"], "pos", "caption_pos", 3, 3).where("caption_pos <> pos")
    order = Window.partitionBy("doc_id", "pos").orderBy(F.abs(F.col("caption_pos") - F.col("pos")), F.col("caption_pos") < F.col("pos"))
    return near.withColumn("n", F.row_number().over(order)).where("n = 1").select("doc_id", "pos", "caption_pos")


@query(f"""WITH {chunks.SQL}, u AS (
  SELECT doc_id, id, pos, 0 AS priority FROM chunks WHERE element_type = 'heading' UNION ALL SELECT doc_id, id, pos, 1 FROM chunks WHERE pos < 4 UNION ALL SELECT doc_id, id, pos, 2 FROM chunks WHERE element_type = 'table_row'),
k AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY doc_id, id ORDER BY priority, pos) = 1)
SELECT doc_id, id, priority, row_number() OVER (PARTITION BY doc_id ORDER BY priority, pos, id) AS place FROM k""")
def ordered_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, opening lines and table rows of a document, each chunk once, in order of priority."""
    rows = chunks.line_chunks(read(spark, sf_dir, "documents")).select("doc_id", "id", "pos", "element_type")
    lists = [rows.where("element_type = 'heading'"), rows.where("pos < 4"), rows.where("element_type = 'table_row'")]
    return joins.ordered_union([x.drop("element_type") for x in lists], "id", ["doc_id"]).select("doc_id", "id", "priority", "place")


@query("""WITH s AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS r, s_acctbal / 10000 AS score FROM supplier),
c AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer)
SELECT coalesce(s.id, c.id) AS id, s.r AS sem_rank, c.r AS lex_rank FROM (SELECT * FROM s WHERE r <= 50) s FULL JOIN (SELECT * FROM c WHERE r <= 80) c ON s.id = c.id""")
def full_outer_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ranked lists side by side by id. The top of each list is taken before its rank is given."""
    def top(table: str, key: str, by: str, k: int, name: str) -> DataFrame:
        rows = read(spark, sf_dir, table).select(F.col(key).alias("id"), F.col(by).alias("v")).orderBy(F.desc("v"), "id").limit(k)
        return rows.select("id", F.row_number().over(Window.orderBy(F.desc("v"), "id")).alias(name))

    return top("supplier", "s_suppkey", "s_acctbal", 50, "sem_rank").join(top("customer", "c_custkey", "c_acctbal", 80, "lex_rank"), "id", "full")
