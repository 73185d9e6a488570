"""URL filtering by association rules.

FP-growth mines combinations of URL tokens that go with a label; rules are pruned by confidence
and support and matched by an inverted index: each rule is posted under its rarest token, the
tokens of a URL look it up there, and the rest of its tokens are then checked. Explicit host and
path rules come first, the longest that fits wins.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from . import common

# The rules of the task (host, path, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
BAD = "label=bad"


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; empty without '://' or for null."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to '?', '#' or the end; empty without '://' or for null."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def first_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name (host and path together) and verdict of the longest rule that fits, else nulls.

    A rule fits its host and all subdomains if the path starts with the rule's path. Longest: by
    host and path together, then by host, then by name.
    """
    fit = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    name = verdict = F
    for k, (h, p, v) in enumerate(sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[0] + r[1]))):
        name = (name if k else F).when(fit(h, p), h + p)
        verdict = (verdict if k else F).when(fit(h, p), v)
    return name, verdict


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: each suffix of the host by labels, its labels, and the words of its path without numbers."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    suffixes = F.transform(F.sequence(F.lit(0), F.size(labels) - 1), lambda i: F.concat(F.lit("under="), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")))
    words = F.filter(F.split(F.lower(path), r"[^\p{L}0-9]+"), lambda x: (x != "") & ~x.rlike("^[0-9]+$"))
    parts = F.filter(F.flatten(F.transform(labels, lambda x: F.split(x, "[-_]"))), lambda x: x != "")
    named = [F.transform(parts, lambda x: F.concat(F.lit("host="), x)), F.transform(words, lambda x: F.concat(F.lit("path="), x))]
    return F.array_distinct(F.concat(F.when(F.size(labels) > 0, suffixes).otherwise(F.array().cast("array<string>")), *named))


def mine(tokens: DataFrame, labels: DataFrame, *, min_support: float = 0.002, least_rows: int = 8, min_confidence: float = 0.6, min_lift: float = 1.5) -> DataFrame:
    """Rules (antecedent, confidence, support) that speak for blocking, from labelled rows.

    tokens: page_id, tokens; labels: doc_id, bad (boolean). A rule needs min_support, and least_rows
    labelled rows, so that a few chance rows make none. A token must have min_support itself; the
    number of rules is thus bounded by the tokens of a URL and 1/min_support, not by the data. Of
    rules with the same confidence, one that contains another is pruned. Without labelled rows, or
    if none is bad, there are no rules.
    """
    rows = tokens.join(labels, tokens["page_id"] == labels["doc_id"]).select(F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items"))
    rows = common.cut(rows)
    n, bad = rows.agg(F.count("*"), F.coalesce(F.sum(F.array_contains("items", BAD).cast("long")), F.lit(0))).first()
    empty = tokens.sparkSession.sql("SELECT array('') antecedent, 0D confidence, 0D support WHERE false")
    if not bad:
        return empty
    min_support = min(1.0, max(min_support, least_rows / n))
    # a rule with a token that all rows have is as sure as the one without it, and would be pruned for that
    counts = rows.select(F.explode("items").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    dull = counts.where(((F.col("n") < min_support * n) | (F.col("n") == n)) & (F.col("token") != BAD))
    kept = sorted(r["token"] for r in counts.join(dull, "token", "left_anti").collect())  # at most the tokens of a URL / min_support
    items = rows.select(F.array_intersect("items", F.lit(kept)).alias("items")).where(F.size("items") > 0)
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    found = model.associationRules.where((F.element_at("consequent", 1) == BAD) & (F.col("lift") >= min_lift))
    found = common.cut(found.select(F.sort_array("antecedent").alias("antecedent"), "confidence", "support"))
    a, b = found.alias("a"), found.alias("b")
    wider = (F.size("a.antecedent") > F.size("b.antecedent")) & (F.size(F.array_except("b.antecedent", "a.antecedent")) == 0) & (F.col("b.confidence") >= F.col("a.confidence"))
    post = b.select(F.col("b.antecedent").alias("antecedent"), F.col("b.confidence").alias("confidence"), F.element_at("b.antecedent", 1).alias("first")).alias("b")
    probe = a.select("a.*", F.explode("a.antecedent").alias("first")).alias("a")
    redundant = probe.join(post, (F.col("a.first") == F.col("b.first")) & wider).select(F.col("a.antecedent").alias("antecedent")).distinct()
    return found.join(redundant, "antecedent", "left_anti")


def fired(tokens: DataFrame, rules: DataFrame, most_rules: int = 20_000) -> DataFrame:
    """page rows with a rule whose tokens they all have: page key columns and the best confidence.

    The index posts each rule under its rarest token (by its count among the URLs' tokens); it is
    broadcast below most_rules rules and shuffled beyond.
    """
    counts = tokens.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    listed = rules.withColumn("rule", F.xxhash64("antecedent"))
    posted = listed.select("rule", "antecedent", "confidence", F.explode("antecedent").alias("token")).join(counts, "token")
    posted = posted.groupBy("rule", "antecedent", "confidence").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    posted = common.cut(posted)
    index = posted.select("token", "antecedent", "confidence")
    if posted.count() <= most_rules:
        index = F.broadcast(index)
    probes = tokens.select("_set", "tokens", F.explode("tokens").alias("token"))
    hits = probes.join(index, "token").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    return hits.groupBy("_set").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame, *, most_sets: int = 1_000_000, **options) -> DataFrame:
    """page_id, host, path, rule, verdict and confidence of each page's url.

    labels: doc_id (a page_id), quality and toxic; a row is bad if it is toxic or of quality 0, nulls
    count as good. A url that no listed rule fits gets `block` if a mined rule fires, else `allow`.
    Null urls have an empty host and path and are allowed. Repeated rows are judged each; several
    labels of a page count as so many rows; null page_ids have no labels. Of a long url all tokens
    count. Of rules that fire the most confident counts. An empty table gives an empty result; other
    columns are not carried, whatever their names.
    """
    url = F.col("url")
    host, path = host_of(url), path_of(url)
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("tokens", url_tokens(F.col("host"), F.col("path")))
    rows = common.cut(rows.withColumn("_set", F.xxhash64("tokens")))
    marks = labels.select("doc_id", (F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))).alias("bad"))
    rules = mine(rows.select("page_id", "tokens"), marks, **options)
    # a set of tokens that many URLs share is judged once
    sets = rows.groupBy("_set").agg(F.first("tokens").alias("tokens"))
    hits = fired(sets, rules)
    name, verdict = first_rule(F.col("host"), F.col("path"))
    hits = common.cut(hits)
    if hits.count() <= most_sets:  # 16 bytes each; beyond that the join is shuffled
        hits = F.broadcast(hits)
    judged = rows.join(hits, "_set", "left")
    return judged.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"), "confidence")
