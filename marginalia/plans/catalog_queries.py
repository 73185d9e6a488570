"""Queries for the catalog and the stateful operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.functions import signals
from marginalia.plans.registry import query, read
from marginalia.sources import catalog
from marginalia.streaming import queues


@query("""WITH h AS (SELECT *, sha256(text) AS content FROM documents)
SELECT lang AS owner, content, count(*) AS copies, max(doc_id) AS newest, max(CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN doc_id END) AS reusable FROM h GROUP BY ALL HAVING count(*) > 1""")
def doc_dedup_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the same owner and content: the newest, and the newest that is indexed."""
    docs = read(spark, sf_dir, "documents").select(F.col("lang").alias("owner"), "doc_id", "text")
    return catalog.reusable(docs, read(spark, sf_dir, "labels"), "owner", F.sha2("text", 256), "doc_id")


@query("""WITH n AS (SELECT o_custkey AS id, arg_max(o_orderpriority, o_orderkey) AS segment, max(o_orderkey) AS k FROM orders GROUP BY o_custkey),
v AS (SELECT n.id, o.o_totalprice AS balance, CASE WHEN n.id % 2 = 0 THEN n.segment END AS segment FROM n JOIN orders o ON o.o_orderkey = n.k)
SELECT coalesce(c.c_custkey, v.id) AS id, coalesce(v.balance, c.c_acctbal) AS balance, coalesce(v.segment, c.c_mktsegment) AS segment, c.c_name AS name FROM customer c FULL JOIN v ON c.c_custkey = v.id""")
def upsert_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last change of each key over the stored row; nulls keep what is stored."""
    old = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"))
    new = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("balance"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderpriority")).alias("segment"), "o_orderkey")
    return catalog.upsert(old, new, ["id"], "o_orderkey")


@query("""WITH new AS (SELECT d.doc_id, item.item_id, item.text FROM documents d JOIN benchmark item ON d.doc_id % 40 = item.item_id SEMI JOIN labels l ON l.doc_id = d.doc_id),
old AS (SELECT doc_id, 1 AS ord, text FROM documents)
SELECT doc_id, ord, text FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new) UNION ALL SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY item_id), text FROM new""")
def replace_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sections of the documents that have labels replaced, the others as they are."""
    docs = read(spark, sf_dir, "documents")
    old = docs.select("doc_id", F.lit(1).alias("ord"), "text")
    items = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    new = docs.join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", (F.col("doc_id") % 40).alias("item_id")).join(items, "item_id").select("doc_id", "item_id", F.col("item").alias("text"))
    return catalog.replace(old, new, "doc_id", "item_id")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def delete_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = read(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return read(spark, sf_dir, "documents").select("doc_id", "source").join(gone, "doc_id", "left_anti")


@query("""WITH f AS (SELECT *, first_value(len(embedding)) OVER (PARTITION BY label ORDER BY vec_id) AS w FROM embeddings WHERE embedding IS NOT NULL),
n AS (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) + 1e-9 AS norm FROM f WHERE len(embedding) = w)
SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) / norm, 6) AS first, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) / norm)), 5) AS total FROM n""")
def normalised_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.same_width(read(spark, sf_dir, "embeddings"), ["label"], "vec_id", "embedding")
    return rows.select("vec_id", F.round(F.col("unit")[0], 6).alias("first"), F.round(F.aggregate("unit", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("""WITH n AS (SELECT max(ts) AS now FROM events),
f AS (SELECT user_id, event_id, ts FROM events, n WHERE ts >= now - INTERVAL 240 HOUR),
k AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5)
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM k""")
def pending_queue_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's queue at the last moment of the table: at most ten days old, the newest five."""
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    now = F.lit(events.agg(F.max("ts")).first()[0])
    return queues.pending(events, "user_id", "ts", now, "240 HOURS", 5).select("user_id", "event_id", "place")


# From which states each state can be reached.
ALLOWED = {"downloading": ["idle", "ready"], "indexing": ["downloading"], "ready": ["indexing", "answering"], "answering": ["ready"], "idle": ["downloading", "indexing", "ready", "answering"]}
TO = {"signup": "downloading", "view": "indexing", "click": "ready", "purchase": "answering", "error": "idle"}


@query("""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, CASE event_type WHEN 'signup' THEN 'downloading' WHEN 'view' THEN 'indexing' WHEN 'click' THEN 'ready' WHEN 'purchase' THEN 'answering' ELSE 'idle' END AS t FROM events),
f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, 'idle' AS state, 0 AS accepted FROM e
  UNION ALL SELECT f.user_id, e.k, CASE WHEN ok THEN e.t ELSE f.state END, f.accepted + CASE WHEN ok THEN 1 ELSE 0 END FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1,
    LATERAL (SELECT (e.t = 'downloading' AND f.state IN ('idle', 'ready')) OR (e.t = 'indexing' AND f.state = 'downloading') OR (e.t = 'ready' AND f.state IN ('indexing', 'answering')) OR (e.t = 'answering' AND f.state = 'ready') OR (e.t = 'idle' AND f.state IN ('downloading', 'indexing', 'ready', 'answering')) AS ok))
SELECT user_id, arg_max(state, k) AS state, max(accepted) AS accepted FROM f GROUP BY user_id""")
def fsm_final_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The processing state of each user after all events."""
    to = F.element_at(F.create_map(*[x for k, v in TO.items() for x in (F.lit(k), F.lit(v))]), F.col("event_type"))
    return queues.final_states(read(spark, sf_dir, "events"), "user_id", "event_id", to, ALLOWED)


@query("""WITH RECURSIVE r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, CAST(floor(epoch(ts)) AS BIGINT) AS moment, (1 + event_id % 30) * 86400 AS plus FROM events WHERE event_type = 'purchase'),
f AS (SELECT user_id, k, moment + plus AS until FROM r WHERE k = 1 UNION ALL SELECT r.user_id, r.k, greatest(f.until, r.moment) + r.plus FROM f JOIN r ON r.user_id = f.user_id AND r.k = f.k + 1)
SELECT user_id, CAST(arg_max(until, k) AS BIGINT) AS until, CAST(max(k) AS INT) AS redeemed FROM f GROUP BY user_id""")
def redeem_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access ends after all redemptions: each extends what is left or starts anew."""
    rows = read(spark, sf_dir, "events").where("event_type = 'purchase'")
    moment = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    return queues.access_until(rows.withColumn("moment", moment), "user_id", "moment", 1 + F.col("event_id") % 30)


@query("SELECT doc_id, CAST(NULL AS VARCHAR) AS owner, text, CAST(NULL AS INTEGER) AS indexer_version, lang, source, n_chars FROM documents")
def additive_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under a schema with columns that they lack; none of theirs is lost."""
    return catalog.evolved(read(spark, sf_dir, "documents"), "doc_id long, owner string, text string, indexer_version int")


@query("""WITH old AS (SELECT p_size AS doc_id, CASE WHEN p_partkey % 3 > 0 THEN 'Рисунок ' || p_partkey || '.1' END AS label, CAST(NULL AS VARCHAR) AS num, 'img' || p_partkey AS image, p_name AS caption FROM part WHERE p_partkey % 4 > 0),
new AS (SELECT p_size AS doc_id, CASE WHEN p_partkey % 3 > 0 THEN 'Рисунок ' || p_partkey || '.1' END AS label, 'img' || p_partkey AS image, CASE WHEN p_partkey % 5 > 0 THEN p_brand END AS caption FROM part WHERE p_partkey % 2 = 0)
SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.label, o.label) AS label, coalesce(nullif(regexp_extract(n.label, '\\d+(\\.\\d+)?'), ''), o.num) AS num, coalesce(n.image, o.image) AS image, coalesce(n.caption, o.caption) AS caption FROM old o FULL JOIN new n ON o.doc_id = n.doc_id AND o.image = n.image""")
def upsert_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures found by label or by image and overlaid, their numbers read from the labels; each comes twice, the later counts."""
    p = read(spark, sf_dir, "part")
    label = F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit("Рисунок "), F.col("p_partkey").cast("string"), F.lit(".1")))
    rows = p.select("p_partkey", F.col("p_size").alias("doc_id"), label.alias("label"), F.lit(None).cast("string").alias("num"), F.concat(F.lit("img"), F.col("p_partkey").cast("string")).alias("image"), F.col("p_name").alias("caption"), "p_brand")
    old = rows.where("p_partkey % 4 > 0").drop("p_partkey", "p_brand")
    new = rows.where("p_partkey % 2 = 0").select("doc_id", "label", "num", "image", F.when(F.col("p_partkey") % 5 > 0, F.col("p_brand")).alias("caption"))
    twice = new.withColumn("at", F.lit(2)).unionByName(new.withColumn("caption", F.lit("early")).withColumn("at", F.lit(1)))
    return catalog.upsert_figures(old, twice, "at")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size <> 7 ELSE true END AS stale, p_partkey % 3 <> 2 AS sources FROM part""")
def index_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which indexes were made by another model or width, and which paths name a list of sources."""
    size = F.col("p_size").cast("string")
    profile = F.element_at(F.array(F.concat(F.lit("emb=small|dim="), size), F.concat(F.lit("emb=large|dim="), size), F.lit("broken"), F.lit(None).cast("string")), (F.col("p_partkey") % 4 + 1).cast("int"))
    path = F.element_at(F.array(F.lit("3 Список литературы"), F.lit("References / 1"), F.col("p_name")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", catalog.stale_profile(profile, "small", 7).alias("stale"), signals.is_reference_section(path).alias("sources"))


@query("""SELECT o_custkey AS doc_id, CAST(0 AS BIGINT) AS "references", CAST(count(*) * 2 AS BIGINT) AS media, false AS empty FROM orders GROUP BY 1 HAVING count(*) >= 3""")
def index_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the chunks of reports of three orders or more hold."""
    from marginalia.plans import context_queries

    many = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).count().where("count >= 3").select("doc_id")
    return catalog.health(context_queries.reports(spark, sf_dir).join(many, "doc_id", "left_semi"))


@query("""WITH e AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS moment, event_id % 500 AS k FROM events WHERE event_type IN ('purchase', 'click')), n AS (SELECT min(CAST(floor(epoch(ts)) AS BIGINT)) AS lo FROM events),
a AS (SELECT user_id, event_id, moment, k, CASE WHEN event_id % 13 = 0 THEN 'BAD ' || k ELSE 'ABCD-EF' || k % 10 || '0-' || lpad(CAST(k AS VARCHAR), 4, '0') END AS code FROM e),
v AS (SELECT *, CASE WHEN event_id % 13 = 0 THEN 'form' WHEN k % 7 = 0 THEN 'unknown' WHEN k % 11 = 0 THEN 'revoked' WHEN k % 5 = 0 AND moment >= lo + 20 * 86400 THEN 'expired' END AS verdict FROM a, n),
u AS (SELECT *, CASE WHEN verdict IS NOT NULL THEN verdict WHEN row_number() OVER (PARTITION BY k, verdict IS NULL ORDER BY moment, event_id) > 1 + k % 3 THEN 'used' ELSE 'accepted' END AS result FROM v),
g AS (SELECT *, sum((1 + k % 30) * 86400) OVER (PARTITION BY user_id ORDER BY moment, event_id) AS s FROM u WHERE result = 'accepted'),
h AS (SELECT event_id, CAST(s + max(moment - (s - (1 + k % 30) * 86400)) OVER (PARTITION BY user_id ORDER BY moment, event_id) AS BIGINT) AS until FROM g)
SELECT user_id, event_id, code, result AS verdict, until FROM u LEFT JOIN h USING (event_id)""")
def redemption_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each attempt at a code comes to, and the access end after each accepted one; codes are malformed, unknown, revoked, expired or used up."""
    events = read(spark, sf_dir, "events").withColumn("at", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000))
    low = events.agg(F.min("at")).first()[0]
    name = lambda k: F.concat(F.lit("ABCD-EF"), (k % 10).cast("string"), F.lit("0-"), F.lpad(k.cast("string"), 4, "0"))
    key, k = F.col("event_id") % 500, F.col("id")
    code = F.when(F.col("event_id") % 13 == 0, F.concat(F.lit("bad "), key.cast("string"))).otherwise(F.concat(F.lit(" "), F.lower(name(key))))
    attempts = events.where("event_type IN ('purchase', 'click')").select("user_id", "event_id", code.alias("code"), "at")
    codes = spark.range(500).where("id % 7 <> 0").select(name(k).alias("code"), ((1 + k % 30) * 86400).alias("duration"), (1 + k % 3).alias("most"), (k % 11 == 0).alias("revoked"), F.when(k % 5 == 0, F.lit(low + 20 * 86400)).alias("expires_at"))
    return queues.redeemed(attempts, codes).select("user_id", "event_id", "code", "verdict", "until")
