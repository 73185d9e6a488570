"""Language identification by Bayesian evidence fusion.

The posterior of a language is the product of three kinds of evidence: the likelihood of the text
(byte trigrams, naive Bayes), the likelihood of the declared markup language, and a prior that is
smoothed along the hierarchy corpus, address suffix, host. The prior and the reliability of
declarations come from grouped aggregation over the whole corpus of what the texts alone say; a
row's own vote is taken out of its host's counts. A background model stands for text of no
known language (`und`).
"""

from __future__ import annotations

import html as markup
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from . import common, url_rules

UND = "und"
HASH_BITS = 15
#: Overlapping trigrams repeat each other's evidence; their log-likelihood counts by this share.
TEXT_WEIGHT = 1 / 3
BACKGROUND_PRIOR = 1e-3


def _classes() -> np.ndarray:
    """Bytes as they are counted: A-Z lower-cased, other ASCII but letters as a space."""
    table = np.arange(256, dtype=np.uint32)
    for b in range(128):
        c = chr(b)
        table[b] = ord(c.lower()) if c.isalpha() else 32
    return table


def grams(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash bucket of the trigram at each byte (the last two have none), whether it has a letter, whether the byte is one."""
    x = _classes()[raw]
    if len(x) < 3:
        return np.zeros(0, np.uint32), np.zeros(0, bool), x != 32
    whole = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    return (whole * np.uint32(2654435761)) >> np.uint32(32 - HASH_BITS), whole != 0x202020, x != 32


def languages(docs: DataFrame, declared: str, sample_rows: int, least_rows: int = 5) -> dict[str, int]:
    """All declared languages of least_rows rows or more, by number of rows, with the hash of doc_id up to which a row is in the sample.

    Hashes are even, so the part of them that holds sample_rows of a language's rows is known from
    their number; the row of the lowest hash is always in.
    """
    counts = docs.groupBy(F.col(declared).alias("lang")).agg(F.count("*").alias("n"), F.min(F.xxhash64("doc_id")).alias("lowest")).where(f"lang IS NOT NULL AND lang <> '' AND n >= {least_rows}")
    part = lambda n: (sample_rows << 64) // n - (1 << 63) if n > sample_rows else (1 << 63) - 1
    return {r["lang"]: max(part(r["n"]), r["lowest"]) for r in counts.orderBy(F.desc("n"), "lang").collect()}


def train(docs: DataFrame, declared: str, bounds: dict[str, int]) -> np.ndarray:
    """Log-probabilities (languages and background, buckets) from the rows of each language up to its bound (as of languages())."""
    known = list(bounds)
    index = {x: i for i, x in enumerate(known)}
    bound = F.create_map(*[F.lit(x) for item in bounds.items() for x in item])
    picked = docs.where(F.col(declared).isin(known)).select(F.col(declared).alias("lang"), "text", F.xxhash64("doc_id").alias("order"))
    picked = picked.where(F.col("order") <= F.element_at(bound, F.col("lang"))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "text"):
                raw, at = common.text_buffers(batch.column("text"))
                buckets, good, _ = grams(raw)
                lang = np.array([index[x] for x in batch.column("lang").to_pylist()], np.int64)
                row = np.repeat(lang, np.diff(at))[: len(buckets)]
                cells, n = np.unique(row[good] * (1 << HASH_BITS) + buckets[good], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells >> HASH_BITS), pa.array(cells & ((1 << HASH_BITS) - 1)), pa.array(n)], ["lang", "bucket", "n"])

    # at most languages * buckets rows, in columns of numbers
    counts = picked.mapInArrow(count, "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((len(known), 1 << HASH_BITS), 0.05)
    table[counts["lang"].to_numpy(), counts["bucket"].to_numpy()] += counts["n"].to_numpy()
    table = np.log(table / table.sum(1, keepdims=True))
    return np.vstack([table, np.full(1 << HASH_BITS, -HASH_BITS * np.log(2))])


def scored(docs: DataFrame, model: np.ndarray, carried: list[str]) -> DataFrame:
    """carried columns and `text_log` (weighted log-likelihoods, languages then background) and `letters` of each row."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carried).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "text"):
                raw, at = common.text_buffers(batch.column("text"))
                buckets, good, letter = grams(raw)
                first = np.minimum(at[:-1], len(buckets))
                last = np.maximum(np.minimum(at[1:] - 2, len(buckets)), first)

                def sums(values):
                    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
                    return total[last] - total[first]

                logs = np.stack([sums(np.where(good, m[buckets], 0)) for m in model], 1) * TEXT_WEIGHT
                count = np.concatenate([[0], np.cumsum(letter)])
                letters = count[at[1:]] - count[at[:-1]]
                lists = pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * len(model), pa.array(logs.ravel()))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], lists, pa.array(letters)], [*carried, "text_log", "letters"])

    return docs.select(*carried, "text").mapInArrow(run, f"{fields}, text_log array<double>, letters long")


def identify(
    docs: DataFrame, *, declared: str = "lang", host: str | None = "source", suffix: str | None = None, carried: list[str] | None = None, prefix: str = "", sample_rows: int = 6000, host_weight: float = 20.0, suffix_weight: float = 50.0, most_hosts: int = 100_000
) -> DataFrame:
    """The carried columns (default doc_id) of each row with detected, posterior, declared_as and kept (their names after prefix).

    docs: doc_id, text, a declared language and, if named, a host and an address suffix. All
    declared languages of five rows or more are known. The text model is fitted on about sample_rows
    rows of each (all, if it has no more), picked by a hash of doc_id (equal ones together); counts, priors and reliabilities cover all rows. kept: the row has a
    letter, its best language is not `und`, and its posterior is at least 0.5. Null or letterless
    texts are `und` and not kept. A null or unknown declaration, host or suffix is a value of its
    own. Ties go to the language with more rows. Each row is judged by itself, repeated or not; with
    no labelled rows all are `und`. Long texts are read whole. An empty table gives an empty result;
    columns of docs may have any names.
    """
    spark, carried = common.session_of(docs), carried or ["doc_id"]
    bounds = languages(docs, declared, sample_rows)
    known = list(bounds)
    n = len(known)
    model = train(docs, declared, bounds) if known else np.full((1, 1 << HASH_BITS), -HASH_BITS * np.log(2))
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c else F.lit("")
    keep = [f"_keep{i}" for i in range(len(carried))]
    source = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(carried, keep, strict=True)], "text", named(declared).alias("_said"), named(host).alias("_host"), named(suffix).alias("_suffix"))
    rows = common.cut(scored(common.spread(source), model, [*keep, "_said", "_host", "_suffix"]))
    languages_only = F.slice("text_log", 1, max(n, 1))
    vote = F.when((F.col("letters") > 0) & (F.array_max("text_log") == F.array_max(languages_only)), F.array_position("text_log", F.array_max("text_log")).cast("int") - 1).otherwise(n)
    rows = rows.withColumn("_vote", vote if known else F.lit(0))

    # votes by suffix and host, then by suffix, then over all; each row of these tables has one count for each language
    tally = [F.count_if(F.col("_vote") == i).alias(f"_n{i}") for i in range(n)]
    hosts = common.cut(rows.groupBy("_suffix", "_host").agg(*tally, F.lit(0).alias("_")).drop("_"))
    again = [F.sum(f"_n{i}").alias(f"_n{i}") for i in range(n)]
    suffixes = hosts.groupBy("_suffix").agg(*again, F.lit(0).alias("_")).drop("_")
    overall = np.array([x or 0 for x in suffixes.agg(*again, F.lit(0)).first()[:n]], float)
    prior = (overall + 1) / (overall.sum() + max(n, 1)) if n else overall
    array = lambda cs: F.array(*cs) if cs else F.array().cast("array<double>")
    total = lambda cs: sum(cs[1:], cs[0]) if cs else F.lit(0)
    counts = [F.col(f"_n{i}") for i in range(n)]
    by_suffix = suffixes.select("_suffix", array([(counts[i] + suffix_weight * prior[i]) / (total(counts) + suffix_weight) for i in range(n)]).alias("_above"))
    by_host = hosts.join(by_suffix, "_suffix").select("_suffix", "_host", array([c.cast("double") for c in counts]).alias("_votes"), "_above")
    if by_host.count() <= most_hosts:  # else a shuffled join, of which Spark splits hot hosts
        by_host = F.broadcast(by_host)
    # how often each language's texts are declared as what; known languages only
    told = rows.where((F.col("_vote") < n) & F.col("_said").isin(known)).groupBy("_said", "_vote").agg(F.count("*").alias("n")).collect()  # at most languages squared
    said = np.ones((n, n + 1)) * 0.5
    for r in told:
        said[r["_vote"], known.index(r["_said"])] += r["n"]
    said = np.log(said / said.sum(1, keepdims=True)) if n else said
    reliability = {x: said[:, j].tolist() for j, x in enumerate(known)}
    none = F.lit([0.0] * n) if n else F.array().cast("array<double>")
    evidence: Column = none
    for x in known:
        evidence = F.when(F.col("_said") == x, F.lit(reliability[x])).otherwise(evidence)

    joined = rows.join(by_host, ["_suffix", "_host"]).withColumn("_evidence", evidence)
    own = lambda i: F.when(F.col("_vote") == i, 1.0).otherwise(0.0)
    left = lambda i: F.get("_votes", i) - own(i)
    seen = F.aggregate("_votes", F.lit(0.0), lambda a, x: a + x) - F.when(F.col("_vote") < n, 1.0).otherwise(0.0)
    logs = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.get("text_log", i) + F.get("_evidence", i) + F.log((left(i) + F.lit(host_weight) * F.get("_above", i)) / (F.col("_seen") + host_weight) * (1 - BACKGROUND_PRIOR)),
    )
    if not known:
        logs = F.array().cast("array<double>")
    # an unlisted declaration is as likely under the background as under any language
    ground = F.element_at("text_log", -1) + F.log(F.lit(BACKGROUND_PRIOR)) - F.when(F.col("_said").isin(known), F.log(F.lit(float(n + 1)))).otherwise(0.0)
    joined = joined.withColumn("_seen", seen).withColumn("_logs", F.concat(logs, F.array(ground)))
    best = F.array_max("_logs")
    joined = joined.withColumn("_best", best)
    posterior = 1 / F.aggregate("_logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_best")))
    names = F.lit([*known, UND])
    detected = F.when(F.col("letters") > 0, F.get(names, (F.array_position("_logs", F.col("_best")) - 1).cast("int"))).otherwise(UND)
    kept = (F.col("_detected") != UND) & (F.col("_posterior") >= 0.5)
    judged = joined.withColumn("_detected", detected).withColumn("_posterior", posterior)
    found = {"detected": F.col("_detected"), "posterior": F.col("_posterior"), "declared_as": F.col("_said"), "kept": kept}
    return judged.select(*[F.col(k).alias(c) for c, k in zip(carried, keep, strict=True)], *[v.alias(prefix + k) for k, v in found.items()])


def markup_language(html: str) -> Column:
    """The language that a page's html element declares, without its region, lower-cased; empty if none."""
    return F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1))


@F.pandas_udf(StringType())
def _unescaped(text: pd.Series) -> pd.Series:
    return text.map(markup.unescape, na_action="ignore")


def markup_text(html: str) -> Column:
    """The text of a page without scripts, styles, comments and tags, its entities as characters."""
    bare = F.regexp_replace(F.col(html), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    return F.trim(_unescaped(F.regexp_replace(bare, r"[ \t\r\n]+", " ")))


def page_rows(pages: DataFrame) -> DataFrame:
    """doc_id (the page_id), text, lang (as the markup declares), host and suffix (the host's last label) of each page's html and url."""
    named = F.regexp_extract(url_rules.host_of(F.col("url")), r"^(?:.*@)?([^:@]*)", 1)
    return pages.select(F.col("page_id").alias("doc_id"), markup_text("html").alias("text"), markup_language("html").alias("lang"), named.alias("host"), F.substring_index(named, ".", -1).alias("suffix"))
