"""Queries for retrieval: BM25, LIKE, verbatim, cosine, boosts, hybrid, items, areas, suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from marginalia.functions import labels, signals
from marginalia.operators import joins, retrieval as R
from marginalia.plans.registry import query, read
from marginalia.sources import chunks, versions

QUESTIONS = "SELECT * FROM (VALUES (1, 'the thing of inan'), (2, 'nicht aulich der schön'), (3, 'que les réau'), (4, 'License version 2.0'), (5, 'de la ciones 3')) AS t(q_id, query)"

TERMS_SQL = f"""q AS ({QUESTIONS}), terms AS (SELECT DISTINCT q_id, unnest(list_filter(regexp_split_to_array(lower(query), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')[1:10]) AS term FROM q),
words AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM documents),
size AS (SELECT doc_id, len(w) AS dl FROM words), stat AS (SELECT count(*) AS n, avg(dl) AS mean FROM size),
cnt AS (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS word FROM words) GROUP BY ALL),
hits AS (SELECT q_id, term, doc_id, sum(tf) AS tf FROM cnt JOIN terms ON starts_with(word, term) GROUP BY ALL),
df AS (SELECT q_id, term, count(*) AS df FROM hits GROUP BY ALL),
bm AS (SELECT q_id, doc_id, round(-sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM hits JOIN df USING (q_id, term) JOIN size USING (doc_id), stat GROUP BY ALL)"""


@query(f"WITH {TERMS_SQL} SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score, doc_id) AS place FROM bm QUALIFY place <= 20")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents of each question; a word of a question stands for all that begin with it."""
    return R.bm25(read(spark, sf_dir, "documents").select("doc_id", "text"), spark.sql(QUESTIONS), 20)


@query(f"""WITH q AS ({QUESTIONS}), s AS (SELECT q_id, doc_id, greatest(0.0, 10.0 - 2.0 * len(list_intersect(regexp_extract_all(text, '\\d+(?:[.,]\\d+)?'), regexp_extract_all(query, '\\d+(?:[.,]\\d+)?')))
  - 0.5 * len(list_filter(list_distinct(string_split(lower(query), ' ')), lambda w: w <> '' AND contains(lower(text), w)))) AS score FROM documents, q)
SELECT q_id, doc_id, score, row_number() OVER (PARTITION BY q_id ORDER BY score, doc_id) AS place FROM s QUALIFY place <= 20""")
def like_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fallback score of substring search, ordered before it is cut."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "text").join(F.broadcast(spark.sql(QUESTIONS)), F.lit(True))  # five questions
    scored = rows.select("q_id", "doc_id", R.like_score(F.col("text"), F.col("query")).cast("double").alias("score"))
    return R.top(scored, ["q_id"], ["score", "doc_id"], 20)


@query("""WITH s AS (SELECT item_id, lower(text) AS t, unnest(range(least(6, CASE WHEN length(text) <= 90 THEN 1 ELSE 1 + (length(text) - 30) // 25 END))) AS piece_no FROM benchmark),
p AS (SELECT item_id, piece_no, substr(t, 1 + 25 * piece_no, 90) AS piece FROM s)
SELECT item_id, doc_id, min(piece_no) AS piece_no, arg_min(strpos(lower(d.text), piece), piece_no) AS at FROM p JOIN documents d ON contains(lower(d.text), piece) WHERE trim(piece) <> '' GROUP BY ALL""")
def verbatim_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents quote which benchmark items, by pieces of ninety characters."""
    return R.verbatim(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


#: Every fiftieth vector is a question; its text is one of these.
ASKED = ["table 3 and 5, 1, 2, 4?", "show figure 4 " + "please " * 14, "what is in chapter 2", "references 1 and 6", "when was 7?"]
ASKED_SQL = "asked AS (SELECT unnest(range(5)) AS slot, unnest(['" + "', '".join(ASKED) + "']) AS query)"
UNIT_SQL = f"""{ASKED_SQL}, u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / (sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))) + 1e-9)) AS v FROM embeddings),
sims AS (SELECT q.vec_id AS q_id, c.vec_id AS id, c.label, round(list_inner_product(q.v, c.v), 6) AS sim FROM u q, u c WHERE q.vec_id % 50 = 0)"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", R.normalised(F.col("embedding")).alias("v"))
    return rows, rows.where("id % 50 = 0").select(F.col("id").alias("q_id"), F.col("v").alias("qv"))


def _query_of(q_id: str):
    return F.element_at(F.lit(ASKED), (F.floor(F.col(q_id) / 50) % len(ASKED) + 1).cast("int"))


@query(f"WITH {UNIT_SQL} SELECT q_id, id, sim, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, id) AS place FROM sims QUALIFY place <= 20")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, asked = _vectors(spark, sf_dir)
    return R.cosine(rows, asked, 20)


KINDS = ["table", "figure", "heading", "reference", "page", "text", "table_row", "text", "text", "heading"]
KIND_SQL = "['" + "','".join(KINDS) + "'][label + 1]"
BOOST_SQL = f"""{UNIT_SQL}, p AS (SELECT *, {KIND_SQL} AS kind, list_distinct([CAST(id % 7 AS VARCHAR), CAST(label AS VARCHAR)]) AS nums FROM sims QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, id) <= 48),
f AS (SELECT p.*, query, regexp_matches(query, '\\btable\\b') AS t, regexp_matches(query, '\\bfigure\\b') AS g, regexp_matches(query, '\\bchapter\\b') AS h, regexp_matches(query, '\\breferences\\b') AS r, len(list_intersect(nums, list_distinct(regexp_extract_all(query, '\\d+')))) AS shared FROM p JOIN asked ON slot = q_id // 50 % 5),
b AS (SELECT q_id, id, kind, query, round(sim + CASE WHEN t AND kind IN ('table', 'table_row') THEN 0.12 ELSE 0 END + CASE WHEN g AND kind = 'figure' THEN 0.14 ELSE 0 END + CASE WHEN h AND kind = 'heading' THEN 0.06 ELSE 0 END
  + CASE WHEN kind = 'reference' THEN CASE WHEN r THEN 0.35 ELSE -0.12 END ELSE 0 END + CASE WHEN regexp_extract(query, 'table (\\d+)', 1) = CAST(id % 17 AS VARCHAR) THEN 0.24 ELSE 0 END + CASE WHEN regexp_extract(query, 'figure (\\d+)', 1) = CAST(id % 19 AS VARCHAR) THEN 0.26 ELSE 0 END + least(0.025 * shared, 0.12)
  - CASE WHEN kind = 'page' AND NOT (t OR g OR h OR r) THEN 0.03 ELSE 0 END - CASE WHEN kind IN ('text', 'heading', 'page') AND id % 5 = 0 THEN 0.04 ELSE 0 END, 6) AS score FROM f)"""


def _boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 48 nearest of each question with their boosted scores; signals and numbers come from the question's text, a chunk's text has two numbers."""
    rows, asked = _vectors(spark, sf_dir)
    near = R.cosine(rows, asked, 48).join(rows.select("id", "label"), "id").withColumn("query", _query_of("q_id"))
    kind = F.element_at(F.lit(KINDS), F.col("label") + 1)
    text = F.concat_ws(" ", F.lit("item"), (F.col("id") % 7).cast("string"), F.lit("of"), F.col("label").cast("string"))
    hit = lambda numbers, n: F.array_contains(numbers(F.col("query")), (F.col("id") % n).cast("string"))
    score = R.boosted(F.col("sim"), kind, signals.asks(F.col("query")), hit(labels.table_numbers, 17), hit(labels.figure_numbers, 19), R.shared_numbers(text, F.col("query")), F.col("id") % 5 == 0)
    return near.select("q_id", "id", kind.alias("kind"), "query", F.round(score, 6).alias("score"))


@query(f"WITH {BOOST_SQL} SELECT q_id, id, kind, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) AS place FROM b")
def cosine_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 48 nearest, ranked anew by types asked for, numbers named and shared, and short texts."""
    return R.top(_boosted(spark, sf_dir).drop("query"), ["q_id"], [F.desc("score"), "id"], 48)


@query(f"WITH {BOOST_SQL} SELECT q_id, id, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) AS place FROM b WHERE score >= CASE WHEN contains(query, 'when') THEN 0.18 ELSE 0.24 END AND (kind <> 'reference' OR contains(query, 'references')) QUALIFY place <= CASE WHEN len(query) > 200 OR len(query) - len(replace(query, ',', '')) > 3 THEN 12 WHEN len(query) > 100 THEN 10 ELSE 8 END")
def retrieve_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits above the threshold (lower for questions of fact), references only if asked for, as many as the question's form asks."""
    facty, query_ = F.col("query").rlike(r"\bwhen\b|сколько|когда"), F.col("query")
    rows = _boosted(spark, sf_dir).where((F.col("score") >= F.when(facty, 0.18).otherwise(0.24)) & ((F.col("kind") != "reference") | signals.asks(query_)["sources"]))
    return R.top(rows, ["q_id"], [F.desc("score"), "id"], 12).where(F.col("place") <= R.adaptive_k(query_)).select("q_id", "id", "score", "place")


@query(f"""WITH {TERMS_SQL}, {UNIT_SQL}, sem AS (SELECT q_id, id, sim FROM sims QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, id) <= 30),
lex5 AS (SELECT q_id, doc_id AS id, score FROM bm QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY score, doc_id) <= 30),
lex AS (SELECT s.q_id, l.id, l.score FROM (SELECT DISTINCT q_id FROM sims) s JOIN lex5 l ON l.q_id = s.q_id // 50 % 5 + 1),
m AS (SELECT coalesce(s.q_id, l.q_id) AS q_id, coalesce(s.id, l.id) AS id, sim, l.score FROM sem s FULL JOIN lex l ON s.q_id = l.q_id AND s.id = l.id),
n AS (SELECT m.*, coalesce(len(list_intersect(regexp_extract_all(text, '\\d+(?:[.,]\\d+)?'), regexp_extract_all(query, '\\d+(?:[.,]\\d+)?'))), 0) AS shared FROM m JOIN q ON q.q_id = m.q_id // 50 % 5 + 1 LEFT JOIN documents ON doc_id = m.id),
r AS (SELECT q_id, id, round(CASE WHEN sim IS NOT NULL THEN sim + CASE WHEN score IS NOT NULL THEN 0.12 ELSE 0 END + least(0.02 * shared, 0.08) ELSE 0.15 / (1 + abs(score)) END, 6) AS score, CASE WHEN sim IS NULL THEN 'lex' WHEN score IS NULL THEN 'sem' ELSE 'both' END AS source FROM n)
SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) AS place FROM r QUALIFY place <= 40""")
def hybrid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic and lexical hits in one list, with the numbers that question and text share; each vector goes with one of five questions."""
    rows, asked = _vectors(spark, sf_dir)
    five = spark.sql(QUESTIONS).select((F.col("q_id") - 1).cast("long").alias("at"), "query")
    asked = asked.withColumn("at", F.floor(F.col("q_id") / 50) % 5)
    sem = versions.cut(R.cosine(rows, asked.drop("at"), 30).select("q_id", "id", "sim"))  # used twice
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = R.bm25(docs, spark.sql(QUESTIONS), 30).select((F.col("q_id") - 1).cast("long").alias("at"), F.col("doc_id").alias("id"), "score")
    lex = asked.select("q_id", "at").join(found, "at").select("q_id", "id", "score")
    # a text's numbers are read once, not for each question that finds it, and texts are not shuffled
    told = docs.select(F.col("doc_id").alias("id"), R.numbers_of(F.col("text")).alias("own"))
    named = asked.select("q_id", "at").join(five, "at").select("q_id", R.numbers_of(F.col("query")).alias("named"))
    shared = sem.select("q_id", "id").join(told, "id").join(named, "q_id").select("q_id", "id", F.size(F.array_intersect("own", "named")).alias("shared"))
    return R.hybrid(sem, lex, shared, 40)


@query(f"""WITH {chunks.SQL}, h AS (SELECT doc_id, id, text, strpos(lower(text), 'licen') AS spot FROM chunks WHERE regexp_matches(lower(text), 'licen[sc]e') AND starts_with(section_path, 'S0'))
SELECT doc_id, id, substr(text, greatest(spot - 120, 1), 240) AS snippet FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY id) <= 3""")
def keyword_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a section that match a pattern, the first three of a document, with what is around the match."""
    rows = chunks.line_chunks(read(spark, sf_dir, "documents")).where(F.lower("text").rlike("licen[sc]e") & F.col("section_path").startswith("S0"))
    at = F.instr(F.lower("text"), "licen")
    rows = rows.select("doc_id", "id", F.substring("text", F.greatest(at - 120, F.lit(1)), F.lit(240)).alias("snippet"))
    return R.top(rows, ["doc_id"], ["id"], 3).drop("place")


@query(f"WITH {TERMS_SQL}, k AS (SELECT q_id, doc_id, score FROM bm QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY score, doc_id) <= 50) SELECT q_id, doc_id, score FROM k QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY q_id) = 1")
def retrieve_items_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of several items in order: a document belongs to the first item that finds it."""
    hits = R.bm25(read(spark, sf_dir, "documents").select("doc_id", "text"), spark.sql(QUESTIONS), 50).drop("place")
    return R.exclusive(hits, [], "q_id", "doc_id")


@query(f"""WITH {chunks.SQL}, h AS (SELECT doc_id, id, text, row_number() OVER (PARTITION BY doc_id ORDER BY id) AS k, coalesce(lead(id) OVER (PARTITION BY doc_id ORDER BY id), 9223372036854775807) AS until FROM chunks WHERE element_type = 'heading'),
t AS (SELECT c.doc_id, c.id, c.text, sum(length(c.text)) OVER (PARTITION BY c.doc_id ORDER BY c.id ROWS UNBOUNDED PRECEDING) AS used FROM chunks c JOIN h ON c.doc_id = h.doc_id AND h.k = 2 AND c.id > h.id AND c.id < h.until)
SELECT doc_id, count(*) AS n, string_agg(left(text, 200), chr(10) ORDER BY id) AS area FROM t WHERE used <= 2500 GROUP BY doc_id""")
def area_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text between a document's second heading and its third, under a budget.

    The interval of a chunk is the number of headings up to it: one window, no range join.
    """
    rows = chunks.line_chunks(read(spark, sf_dir, "documents"))
    w = Window.partitionBy("doc_id").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("k", F.count_if(F.col("element_type") == "heading").over(w)).where("k = 2 AND element_type <> 'heading'")
    rows = rows.withColumn("used", F.sum(F.length("text")).over(w)).where("used <= 2500")
    items = F.sort_array(F.collect_list(F.struct("id", F.substring("text", 1, 200).alias("t"))))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.array_join(F.transform(items, lambda x: x["t"]), "\n").alias("area"))


TYPED = "SELECT * FROM (VALUES (1, 'lavender linen'), (2, 'azure antique'), (3, 'part#12'), (4, 'metalic')) AS t(q_id, typed)"


@query(f"WITH q AS ({TYPED}), n AS (SELECT DISTINCT p_name FROM part) SELECT q_id, p_name, levenshtein(typed, p_name) AS distance, row_number() OVER (PARTITION BY q_id ORDER BY levenshtein(typed, p_name), p_name) AS place FROM q, n QUALIFY place <= 5")
def label_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest labels by edit distance of each typed one that has no match."""
    names = read(spark, sf_dir, "part").select("p_name").distinct()
    pairs = names.join(F.broadcast(spark.sql(TYPED)), F.lit(True))  # four typed labels
    return R.top(pairs.select("q_id", "p_name", F.levenshtein("typed", "p_name").alias("distance")), ["q_id"], ["distance", "p_name"], 5)


@query(f"""WITH {chunks.SQL}, d AS (SELECT doc_id, id, text, CASE WHEN pos % 10 = 0 THEN 1 + pos // 10 % 3 END AS depth FROM chunks),
h AS (SELECT * FROM d WHERE depth IS NOT NULL)
SELECT a.id, (SELECT min(b.id) FROM h b WHERE b.doc_id = a.doc_id AND b.id > a.id AND b.depth <= a.depth) AS until FROM h a""")
def heading_depth_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each heading's section ends: the next heading that is no deeper. Depths are few, so one window each."""
    rows = chunks.line_chunks(read(spark, sf_dir, "documents")).where("pos % 10 = 0").select("doc_id", "id", (1 + F.floor(F.col("pos") / 10) % 3).alias("depth"))
    after = Window.partitionBy("doc_id").orderBy("id").rowsBetween(1, Window.unboundedFollowing)
    rows = rows.select("id", "doc_id", "depth", *[F.min(F.when(F.col("depth") <= d, F.col("id"))).over(after).alias(f"u{d}") for d in (1, 2, 3)])
    return rows.select("id", F.when(F.col("depth") == 1, F.col("u1")).when(F.col("depth") == 2, F.col("u2")).otherwise(F.col("u3")).alias("until"))


@query(f"""WITH {chunks.SQL}, f AS (SELECT doc_id, id, pos, element_type, text, max(CASE WHEN element_type = 'table_row' THEN id END) OVER (PARTITION BY doc_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS anchor FROM chunks),
s AS (SELECT *, max(CASE WHEN element_type = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, anchor ORDER BY id ROWS UNBOUNDED PRECEDING) AS stopped, row_number() OVER (PARTITION BY doc_id, anchor ORDER BY id) - 1 AS k FROM f WHERE anchor IS NOT NULL)
SELECT anchor, id, k FROM s WHERE stopped = 0 AND k BETWEEN 1 AND 3""")
def following_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three paragraphs after a table row, until a heading or the next row."""
    rows = chunks.line_chunks(read(spark, sf_dir, "documents")).select("doc_id", "id", "element_type")
    rows = joins.as_of(rows, ["doc_id"], "id", F.col("element_type") == "table_row", ["id"], prefix="anchor_").where("anchor_id IS NOT NULL")
    w = Window.partitionBy("doc_id", "anchor_id").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("stopped", F.bool_or(F.col("element_type") == "heading").over(w)).withColumn("k", F.count("*").over(w) - 1)
    return rows.where("NOT stopped AND k BETWEEN 1 AND 3").select(F.col("anchor_id").alias("anchor"), "id", "k")
