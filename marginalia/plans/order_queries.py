"""Queries for ordered operators: fill-forward, top-k, round robin, budgets, batches, line grouping."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from marginalia.operators import aggregates, allocation, ordering
from marginalia.plans.registry import query, read
from marginalia.sources import chunks


@query(f"""WITH {chunks.SQL}, d AS (SELECT *, CASE WHEN element_type <> 'heading' THEN NULL WHEN pos = 0 THEN 'intro' WHEN length(text) < 60 THEN 'conclusion' WHEN contains(text, ' | ') THEN 'appendix' ELSE 'chapter_' || (pos // 10) END AS found FROM chunks)
SELECT id, last_value(found IGNORE NULLS) OVER (PARTITION BY owner_id, doc_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS role FROM d""")
def role_fill_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A role found at a heading holds for all chunks up to the next one that is found."""
    rows = chunks.line_chunks(read(spark, sf_dir, "documents"))
    text, section = F.col("text"), F.floor(F.col("pos") / 10).cast("string")
    found = F.when(F.col("element_type") != "heading", None).when(F.col("pos") == 0, "intro").when(F.length(text) < 60, "conclusion").when(text.contains(" | "), "appendix").otherwise(F.concat(F.lit("chapter_"), section))
    return ordering.fill_forward(rows, ["owner_id", "doc_id"], "id", found, "role").select("id", "role")


@query("""WITH r AS (SELECT l_returnflag, l_shipmode AS b, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag, l_shipmode ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM (SELECT *, l_linenumber % 4 AS l_shipmode FROM lineitem))
SELECT l_returnflag, b AS bucket, l_orderkey, l_linenumber, rank, row_number() OVER (PARTITION BY l_returnflag ORDER BY rank, b) AS place FROM r WHERE rank <= 12""")
def coverage_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best twelve of each bucket, interleaved by rank."""
    rows = read(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_linenumber") % 4).alias("bucket"), "l_orderkey", "l_linenumber", "l_extendedprice")
    return ordering.round_robin(rows, ["l_returnflag"], "bucket", [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 12).drop("l_extendedprice")


@query(f"""WITH {chunks.SQL}, b AS (SELECT doc_id, id, '[S' || row_number() OVER (PARTITION BY doc_id ORDER BY id) || ' | ' || section_path || ' | id=' || id || ']' || chr(10) || text AS block FROM chunks WHERE trim(text) <> ''),
s AS (SELECT *, 6000 - (sum(length(block)) OVER (PARTITION BY doc_id ORDER BY id ROWS UNBOUNDED PRECEDING) - length(block)) AS room FROM b)
SELECT doc_id, string_agg(left(block, CAST(room AS BIGINT)), chr(10) || chr(10) ORDER BY id) AS context, count(*) AS n FROM s WHERE room > 0 GROUP BY doc_id""")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled blocks in order under 6000 characters, the last one cut."""
    rows = chunks.line_chunks(read(spark, sf_dir, "documents")).where(F.trim("text") != "")
    label = F.concat(F.lit("[S"), F.row_number().over(Window.partitionBy("doc_id").orderBy("id")).cast("string"), F.lit(" | "), F.col("section_path"), F.lit(" | id="), F.col("id").cast("string"), F.lit("]\n"), F.col("text"))
    rows = aggregates.budget_prefix(rows.select("doc_id", "id", label.alias("block")), ["doc_id"], ["id"], F.length("block"), 6000, cut_last=True)
    rows = rows.withColumn("block", F.substring("block", F.lit(1), F.col("room").cast("int")))
    items = F.sort_array(F.collect_list(F.struct("id", "block")))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(items, lambda x: x["block"]), "\n\n").alias("context"), F.count("*").alias("n"))


@query("""WITH r AS (SELECT source, lang AS item, doc_id, length(text) AS n, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS rank FROM documents WHERE length(text) >= 80),
i AS (SELECT *, count(DISTINCT item) OVER (PARTITION BY source) AS items FROM r),
s AS (SELECT *, least(18000, 6000 + 900 * (items - 1)) - (sum(n) OVER (PARTITION BY source ORDER BY rank, item ROWS UNBOUNDED PRECEDING) - n) AS room FROM i)
SELECT source, item, doc_id, rank, CAST(least(n, room) AS BIGINT) AS chars FROM s WHERE room > 0""")
def context_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 80 characters or more, round robin over items, under a budget that grows with the items."""
    rows = read(spark, sf_dir, "documents").select("source", F.col("lang").alias("item"), "doc_id", F.length("text").alias("n")).where("n >= 80")
    rows = ordering.round_robin(rows, ["source"], "item", ["doc_id"])
    items = rows.groupBy("source").agg(F.count_distinct("item").alias("items"))
    w = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    limit = F.least(F.lit(18000), 6000 + 900 * (F.col("items") - 1))
    rows = rows.join(items, "source").withColumn("room", limit - (F.sum("n").over(w) - F.col("n"))).where("room > 0")
    return rows.select("source", "item", "doc_id", "rank", F.least("n", "room").cast("bigint").alias("chars"))


@query("""WITH n AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, o_orderkey FROM n WHERE n <= 5 OR k <= 3 OR k > n - 2""")
def section_head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rows of the head and two of the tail of each group."""
    return ordering.head_and_tail(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", 5)


@query("""WITH n AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, o_orderkey FROM n WHERE k >= floor(n * 0.2) AND k < floor(n * 0.8) AND k < floor(n * 0.2) + 6""")
def middle_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle of each ranked list, from a fifth to four fifths, at most six."""
    return ordering.middle(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", 0.2, 0.8, 6)


@query("""WITH b AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events WHERE trim(event_type) <> '')
SELECT user_id, event_id, event_type FROM b WHERE p IS DISTINCT FROM event_type""")
def consecutive_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return ordering.without_repeats(rows, ["user_id"], "event_id", "event_type")


@query("""WITH t AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(left(o_orderpriority, 1) AS INT) DESC, o_orderkey) AS place FROM orders)
SELECT o_custkey, o_orderkey, place, (place - 1) // 3 AS batch FROM t WHERE place <= 12""")
def batch_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks by priority, stable, the first twelve, in batches of three."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc(F.substring("o_orderpriority", 1, 1).cast("int")), "o_orderkey")
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("place")).where("place <= 12")
    return rows.withColumn("batch", F.floor((F.col("place") - 1) / 3).cast("bigint"))


@query("""WITH t AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place, max(o_orderkey) OVER (PARTITION BY o_custkey) AS active FROM orders)
SELECT o_custkey, o_orderkey, place, o_orderkey = active AS is_active FROM t WHERE place <= 10""")
def list_user_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest ten of each owner and which of them is the active one."""
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    w = Window.partitionBy("o_custkey")
    rows = orders.select("o_custkey", "o_orderkey", F.row_number().over(w.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))).alias("place"), F.max("o_orderkey").over(w).alias("active")).where("place <= 10")
    return rows.select("o_custkey", "o_orderkey", "place", (F.col("o_orderkey") == F.col("active")).alias("is_active"))


@query(f"""WITH {chunks.SQL}, t AS (SELECT doc_id, id, split_part(section_path, ' [row ', 1) AS base, text FROM chunks WHERE element_type = 'table_row'),
g AS (SELECT doc_id, base, arg_min(text, id) AS header, count(*) AS n FROM t GROUP BY ALL)
SELECT t.id, coalesce(nullif(regexp_extract(t.base, '([0-9]+)$', 1), ''), left(g.header, 20)) AS caption_num, left(g.header, 160) AS header_preview, g.n AS n_rows FROM t JOIN g USING (doc_id, base)""")
def enrich_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caption number and header preview of each table, given to all of its rows; one window, no join."""
    rows = chunks.line_chunks(read(spark, sf_dir, "documents")).where("element_type = 'table_row'").select("doc_id", "id", F.substring_index("section_path", " [row ", 1).alias("base"), "text")
    w = Window.partitionBy("doc_id", "base")
    header = F.first("text").over(w.orderBy("id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    number = F.regexp_extract("base", "([0-9]+)$", 1)
    return rows.select("id", F.coalesce(F.nullif(number, F.lit("")), F.substring(header, 1, 20)).alias("caption_num"), F.substring(header, 1, 160).alias("header_preview"), F.count("*").over(w).alias("n_rows"))


@query(f"""WITH {chunks.SQL}, p AS (SELECT doc_id, id, CASE WHEN element_type = 'table_row' THEN NULL ELSE pos // 5 END AS page, text FROM chunks),
s AS (SELECT *, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY page ASC NULLS FIRST, id ROWS UNBOUNDED PRECEDING) AS total FROM p)
SELECT doc_id, id, page FROM s WHERE total <= 2000""")
def first_chunks_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by page, missing pages first, while they fit into 2000 characters."""
    page = F.when(F.col("element_type") != "table_row", F.floor(F.col("pos") / 5))
    rows = chunks.line_chunks(read(spark, sf_dir, "documents")).select("doc_id", "id", page.alias("page"), "text")
    return aggregates.budget_prefix(rows, ["doc_id"], [F.asc_nulls_first("page"), "id"], F.length("text"), 2000, cut_last=False).select("doc_id", "id", "page")




@query("""WITH RECURSIVE r AS (SELECT l_orderkey AS doc_id, l_linenumber AS pos, l_quantity / 4 AS top, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber) AS k FROM lineitem),
f AS (SELECT doc_id, pos, k, top AS start, 1 AS line_no FROM r WHERE k = 1
  UNION ALL SELECT r.doc_id, r.pos, r.k, CASE WHEN abs(r.top - f.start) > 2.0 THEN r.top ELSE f.start END, f.line_no + CASE WHEN abs(r.top - f.start) > 2.0 THEN 1 ELSE 0 END FROM f JOIN r ON r.doc_id = f.doc_id AND r.k = f.k + 1)
SELECT doc_id, pos, line_no FROM f""")
def words_to_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words grouped into lines: a new line where a word is more than 2 away from the line's first word.

    The state is the first word of the open line, so it is a fold over each page's sorted words.
    """
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_quantity") / 4).alias("top"), F.col("l_linenumber").alias("pos"))
    pages = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("top", "pos"))).alias("words"))

    def step(s, x):
        new = (F.size(s["out"]) == 0) | (F.abs(x["top"] - s["start"]) > 2.0)
        line = s["line"] + F.when(new, 1).otherwise(0)
        return F.struct(F.when(new, x["top"]).otherwise(s["start"]).alias("start"), line.alias("line"), F.concat(s["out"], F.array(F.struct(x["pos"].alias("pos"), line.alias("line_no")))).alias("out"))

    start = F.struct(F.lit(0.0).alias("start"), F.lit(0).alias("line"), F.array().cast("array<struct<pos:int,line_no:int>>").alias("out"))
    return pages.select("doc_id", F.explode(F.aggregate("words", start, step, lambda s: s["out"])).alias("x")).select("doc_id", "x.pos", "x.line_no")


@query("""WITH RECURSIVE h AS (SELECT l_suppkey AS q, l_linenumber AS item, l_partkey % 40 AS chunk, max(l_extendedprice) AS score FROM lineitem GROUP BY ALL),
l AS (SELECT q, item, list(chunk ORDER BY score DESC, chunk) AS chunks FROM h GROUP BY ALL), i AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY item) AS k FROM l),
g AS (SELECT q, CAST(0 AS BIGINT) AS k, CAST(NULL AS INTEGER) AS item, CAST([] AS BIGINT[]) AS got, CAST([] AS BIGINT[]) AS used FROM i WHERE k = 1
  UNION ALL SELECT g.q, i.k, CAST(i.item AS INTEGER), n.pick, list_concat(g.used, n.pick) FROM g JOIN i ON i.q = g.q AND i.k = g.k + 1, LATERAL (SELECT list_filter(CAST(i.chunks AS BIGINT[]), lambda c: NOT list_contains(g.used, c))[1:5] AS pick) n),
a AS (SELECT q, item, unnest(got) AS chunk, unnest(range(1, len(got) + 1)) AS rank FROM g WHERE k > 0),
w AS (SELECT q, min(item) AS item, chunk FROM h ANTI JOIN a USING (q, chunk) WHERE item IN (2, 5) GROUP BY q, chunk),
b AS (SELECT w.q, w.item, w.chunk, row_number() OVER (PARTITION BY w.q, w.item ORDER BY h.score DESC, w.chunk) AS rank FROM w JOIN h USING (q, item, chunk)),
o AS (SELECT q, chunk, max(score) AS score FROM h ANTI JOIN a USING (q, chunk) GROUP BY ALL), f AS (SELECT q, chunk, row_number() OVER (PARTITION BY q ORDER BY score DESC, chunk) AS rank FROM o ANTI JOIN b USING (q, chunk) QUALIFY rank <= 4),
p AS (SELECT q, item, chunk, rank, 0 AS part, rank AS turn FROM a UNION ALL SELECT q, item, chunk, rank, 1, 0 FROM b UNION ALL SELECT q, NULL, chunk, rank, 2, 0 FROM f)
SELECT q, CAST(item AS INTEGER) AS item, chunk, CAST(row_number() OVER (PARTITION BY q ORDER BY part, turn, item NULLS FIRST, rank) AS INTEGER) AS place FROM p""")
def covered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks for the items of each question under a quota of five, with all values for two of the items and four more of the whole question."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("q"), F.col("l_linenumber").alias("item"), (F.col("l_partkey") % 40).alias("chunk"), F.col("l_extendedprice").alias("score"))
    hits = rows.groupBy("q", "item", "chunk").agg(F.max("score").alias("score"))
    overall = rows.groupBy("q", "chunk").agg(F.max("score").alias("score"))
    wants = hits.where("item IN (2, 5)").select("q", "item").distinct()
    return allocation.covered(hits, overall, ["q"], "item", "chunk", [F.desc("score"), "chunk"], quota=5, backfill=4, wants_all=wants).select("q", F.col("item").cast("int").alias("item"), "chunk", "place")
