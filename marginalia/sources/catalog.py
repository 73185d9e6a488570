"""Catalog writes as joins: upserts, replacement, deletion, reuse by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marginalia.sources.versions import cut


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Old rows overlaid by the last new row of each key (by `order`); a null in the new row keeps the old value."""
    last = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_n = 1").drop("_n", order)
    values = [c for c in old.columns if c not in keys]
    a, b = old.alias("a"), last.alias("b")
    both = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full_outer")
    return both.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], *[F.coalesce(f"b.{c}", f"a.{c}").alias(c) if c in last.columns else F.col(f"a.{c}").alias(c) for c in values])


def replace(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Old rows of keys that new has not, and all of new, with ord from 1 within the key."""
    fresh = new.withColumn("ord", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(fresh.select(*old.columns))


def reusable(docs: DataFrame, having: DataFrame, owner: str, content: Column, key: str) -> DataFrame:
    """For each (owner, content) with more than one row: the newest key that has chunks, or null."""
    held = docs.withColumn("content", content).join(having.select(key).distinct().withColumn("_has", F.lit(True)), key, "left")
    return held.groupBy(owner, "content").agg(F.count("*").alias("copies"), F.max(key).alias("newest"), F.max(F.when(F.col("_has"), F.col(key))).alias("reusable")).where("copies > 1")


def same_width(rows: DataFrame, keys: list[str], order: str, vector: str) -> DataFrame:
    """Rows whose vector is as wide as the first of their group, L2-normalised with 1e-9 added to the norm."""
    first = F.first(F.size(vector)).over(Window.partitionBy(*keys).orderBy(order))
    v = F.col(vector).cast("array<double>")
    rows = rows.where(F.col(vector).isNotNull()).withColumn("_width", first).where(F.size(vector) == F.col("_width")).drop("_width")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)) + 1e-9
    return rows.withColumn("_norm", norm).withColumn("unit", F.transform(v, lambda x: x / F.col("_norm"))).drop("_norm")


def evolved(rows: DataFrame, schema: str) -> DataFrame:
    """rows with the columns of a schema that they lack added as nulls, and theirs that it lacks kept behind: additive migration, nothing is dropped."""
    wanted = rows.sparkSession.createDataFrame([], schema).schema
    have = {c.lower(): c for c in rows.columns}
    columns = [(F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted]
    known = {f.name.lower() for f in wanted}
    return rows.select(*columns, *[F.col(f"`{c}`") for c in rows.columns if c.lower() not in known])


def upsert_figures(old: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Figures (doc_id, label, num, image, caption) overlaid by new ones, found by (doc_id, label), else by (doc_id, image); num is read from the label where it is null.

    Nulls of a new row keep the old value; of several new rows of a figure the last counts; rows that
    are found neither way are added. A figure without label and image is always a new one.
    """
    last = new.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", F.coalesce("label", F.concat(F.lit("\0"), "image"))).orderBy(F.desc(order)))).where("_n = 1 OR (label IS NULL AND image IS NULL)").drop("_n", order)
    number = F.nullif(F.regexp_extract("label", r"\d+(?:\.\d+)?", 0), F.lit(""))
    # written once, as numbers of rows are others whenever they are made again
    last = cut(last.withColumn("num", F.coalesce("num", number)).withColumn("_new", F.monotonically_increasing_id()))
    held = cut(old.withColumn("_old", F.monotonically_increasing_id()))
    by_label = last.join(held.select("doc_id", "label", "_old"), ["doc_id", "label"]).select("_new", "_old", F.lit(1).alias("way"))
    by_image = last.join(held.select("doc_id", "image", "_old"), ["doc_id", "image"]).select("_new", "_old", F.lit(2).alias("way"))
    match = by_label.unionByName(by_image).groupBy("_new").agg(F.min(F.struct("way", "_old")).alias("m")).select("_new", F.col("m._old").alias("_old"))
    a, b = held.alias("a"), last.join(match, "_new", "left").alias("b")
    both = a.join(b, F.col("a._old") == F.col("b._old"), "full_outer")
    return both.select(*[F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in old.columns])


def stale_profile(profile: Column, model: str, width: int) -> Column:
    """Whether an index's profile ('emb=model|dim=width') names another embedding model or width than the present one, or none."""
    told = F.str_to_map(F.coalesce(profile, F.lit("")), F.lit(r"\|"), F.lit("="))
    return ~(told["emb"].eqNullSafe(F.lit(model)) & told["dim"].eqNullSafe(F.lit(str(width))))


def health(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, references, media and empty of each document's chunks: what an index lacks is indexed again."""
    kind = F.col("element_type")
    return chunks.groupBy(key).agg(F.count_if(kind == "reference").alias("references"), F.count_if(kind.isin("figure", "table")).alias("media"), (F.sum(F.length(F.trim("text"))) < 500).alias("empty"))
