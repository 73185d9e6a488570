"""Document fingerprints by winnowing, in DataFrame functions only.

Every run of k code points has a hash that rolls along the text: it is put together from the hashes
of shorter runs, which neighbouring runs share. Of each window of w hashes the smallest is chosen,
the rightmost on ties. Any passage of at least k + w - 1 code points that two texts share leaves a
common hash in both fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common

K, W = 16, 16
#: Low bits of an entry hold a position; a string has no more code points than that.
POSITION_BITS = 31
POSITIONS = (1 << POSITION_BITS) - 1
#: Windows that are looked at together, so that the arrays of a long text stay small.
STRETCH = 1 << 15


def once(value: Column, use) -> Column:
    """use(value), with the value computed a single time."""
    return F.element_at(F.transform(F.array(value), lambda x: use(x)), 1)


def joined_runs(values: Column, span: int, join, use) -> Column:
    """use(array of join(...) of the `span` values from each place on), by runs of about the root of span; beyond the end there are nulls."""
    step = 1
    while step * step < span:
        step += 1

    def level(held: Column, places: list[int], then) -> Column:
        made = F.transform(held, lambda x, i: join(x, *[F.get(held, i + p) for p in places]))
        return once(made, then) if places else then(held)

    starts = [*range(step, span - step, step), *([span - step] if span > step else [])]
    return level(values, list(range(1, step)), lambda short: level(short, starts, use))


def chosen(text: Column, k: int = K, w: int = W, base: Column | int = 0) -> Column:
    """Entries of the chosen hashes in order of position: array of long.

    An entry holds 32 bits of the hash of k code points (of all of a shorter text) and, in its low 31
    bits, the position of the first of them, from `base`. Empty for an empty text, null for null. A
    text of fewer than k + w - 1 code points is a single window.
    """

    def stretch(start: Column) -> Column:
        piece = F.substring(text, start + 1, F.lit(STRETCH + k + w - 2))
        grams = F.greatest(F.length(piece) - (k - 1), F.lit(1))
        order = lambda hashes: F.transform(F.slice(hashes, 1, grams), lambda h, i: F.shiftleft(h.bitwiseAND(F.lit(0xFFFFFFFF)), POSITION_BITS).bitwiseOR((F.lit(POSITIONS) - i).cast("long")))
        least = lambda keys: F.array_distinct(F.slice(keys, 1, F.greatest(grams - (w - 1), F.lit(1))))
        hashes = F.transform(F.split(piece, ""), lambda c: F.xxhash64(c))
        found = once(hashes, lambda h: joined_runs(h, k, F.xxhash64, lambda rolled: once(order(rolled), lambda keys: joined_runs(keys, w, F.least, least))))
        # the rightmost of equal hashes had the smallest key; now positions count from the left
        place = lambda key: F.lit(POSITIONS).cast("long") - key.bitwiseAND(F.lit(POSITIONS).cast("long")) + start + base
        return F.transform(found, lambda key: key.bitwiseAND(F.lit(~POSITIONS)).bitwiseOR(place(key).cast("long")))

    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - (k + w - 1), F.lit(0)), F.lit(STRETCH))
    return F.when(F.length(text) == 0, F.array().cast("array<long>")).otherwise(F.array_distinct(F.flatten(F.transform(starts, stretch))))


def position(entry: Column) -> Column:
    return entry.bitwiseAND(F.lit(POSITIONS).cast("long"))


def hash_of(entry: Column) -> Column:
    return F.shiftrightunsigned(entry, POSITION_BITS)


def packed(fingerprint: Column, length: Column) -> Column:
    """The entries at 6 bytes each, as they are shuffled: for each stretch of the text their hashes (shifted to fit an int) and places in the stretch."""
    size = F.lit(STRETCH).cast("long")
    within = lambda k: F.filter(fingerprint, lambda e: F.floor(position(e) / size) == k)

    def one(held: Column) -> Column:
        hashes = F.transform(held, lambda e: (hash_of(e) - F.lit(1 << 31)).cast("int"))
        return F.struct(hashes.alias("hashes"), F.transform(held, lambda e: (position(e) % size).cast("short")).alias("places"))

    every = F.transform(F.sequence(F.lit(0).cast("long"), F.floor(length / size)), lambda k: once(within(k), one))
    return F.when(length < STRETCH, F.array(once(fingerprint, one))).otherwise(every)


def unpacked(stretches: Column) -> Column:
    entry = lambda h, p, k: F.shiftleft(h.cast("long") + F.lit(1 << 31), POSITION_BITS).bitwiseOR(p.cast("long") + k.cast("long") * STRETCH)
    return F.flatten(F.transform(stretches, lambda s, k: F.zip_with(s["hashes"], s["places"], lambda h, p: entry(h, p, k))))


def chosen_after_edit(fingerprint: Column, edited: Column, same: Column, k: int = K, w: int = W) -> Column:
    """Entries of an edited text whose first `same` code points are those of the text that fingerprint is of.

    Windows that lie in the same part choose the same; the others are looked at from the last of
    these windows on.
    """
    first = F.greatest(same - (k + w - 1), F.lit(0)).cast("int")
    rest = once(F.struct(F.substring(edited, first + 1, F.length(edited)).alias("t"), first.alias("f")), lambda x: chosen(x["t"], k, w, x["f"]))
    before = lambda tail: F.filter(fingerprint, lambda e: position(e) < position(F.element_at(tail, 1)))
    # without a whole window in the same part nothing is known beforehand
    return once(rest, lambda tail: F.when(same < k + w - 1, tail).otherwise(F.concat(before(tail), tail)))


def hashes_of(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, hash_of))


def likeness(a: Column, b: Column) -> Column:
    """Shared part of two arrays of distinct hashes: intersection by union; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def printed(fingerprint: Column) -> Column:
    """hash@position of each chosen hash, in order."""
    return F.array_join(F.transform(fingerprint, lambda x: F.concat(F.hex(hash_of(x)), F.lit("@"), position(x).cast("string"))), " ")


def place_among(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are below the key, by two steps of about the square root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    # the part before the first one that begins at or above the key
    part = F.greatest(F.size(F.filter(F.lit([p[0] for p in parts]), lambda b: b < key)) - 1, F.lit(0))
    inside = F.array(*[F.lit(p) for p in parts])
    return part * step + F.size(F.filter(F.get(inside, part), lambda b: b < key))


def followed(rows: DataFrame, carried: list[str], rows_per_bucket: int = 4000, most_buckets: int = 50_000) -> DataFrame:
    """Distinct rows (doc_id, _tie, carried) with next_<c> of the next row by descending doc_id, then _tie; the first row follows the last.

    _tie: a hexadecimal hash. Buckets are ranges of doc_id; a doc_id (or null) of more rows than a
    bucket should have is cut by ranges of _tie. The first row of each bucket also goes to the bucket
    before it, so that no bucket needs another and the text is shuffled once. Beyond most_buckets
    they grow (and their sort spills). Null doc_ids come last.
    """
    spark = rows.sparkSession
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    n, = rows.agg(F.count("*")).first()
    if not n:
        return rows.select("*", *[F.col(c).alias(f"next_{c}") for c in carried])
    per = max(min(rows_per_bucket, n // (4 * spark.sparkContext.defaultParallelism) + 1), -(-n // most_buckets))
    steps = max(1, n // per)
    bounds = rows.agg(F.percentile_approx(key, [i / steps for i in range(1, steps)], max(10_000, 5 * steps))).first()[0] if steps > 1 else []
    # doc_ids of many rows are buckets of their own; there are at most n / per of them
    hot = [(r["k"], -(-r["count"] // per)) for r in rows.groupBy(key.alias("k")).count().where(F.col("count") > per).collect()]
    bounds = sorted({*bounds, *(k for k, _ in hot), *(k - 1 for k, _ in hot if k > -(1 << 63))})
    rows = rows.withColumn("_key", key)
    if hot:
        cuts = spark.createDataFrame(hot, "_key long, _cuts long")
        rows = rows.join(F.broadcast(cuts), "_key", "left")
        share = F.conv(F.substring("_tie", 1, 8), 16, 10).cast("long")
        part = F.coalesce(F.shiftright(share * F.col("_cuts"), 32), F.lit(0))
        rows = rows.withColumn("_part", part).drop("_cuts")
    else:
        rows = rows.withColumn("_part", F.lit(0).cast("long"))
    # rows are read by descending bucket; a bucket of a doc_id is read by ascending part
    bucket = F.shiftleft(place_among(F.col("_key"), bounds).cast("long"), 32) - F.col("_part")
    rows = rows.withColumn("_bucket", bucket).drop("_part")
    tops = rows.groupBy("_bucket").agg(F.min(F.struct(F.expr("-1 - _key").alias("k"), "_tie")).alias("t")).orderBy(F.desc("_bucket")).collect()  # one row a bucket
    used = [r["_bucket"] for r in tops]
    before = {b: used[i - 1] if i else used[-1] for i, b in enumerate(used)}  # the bucket that is read just before; the highest follows the lowest
    links = spark.createDataFrame([(r["_bucket"], -1 - r["t"]["k"], r["t"]["_tie"], before[r["_bucket"]]) for r in tops], "_bucket long, _top long, _top_tie string, _before long")
    linked = rows.join(F.broadcast(links), "_bucket")
    first = (F.col("_key") == F.col("_top")) & (F.col("_tie") == F.col("_top_tie"))
    again = F.when(first, F.array(F.struct(F.lit(True).alias("own"), F.col("_bucket").alias("at")), F.struct(F.lit(False).alias("own"), F.col("_before").alias("at"))))
    dealt = linked.withColumn("_to", F.explode(F.coalesce(again, F.array(F.struct(F.lit(True).alias("own"), F.col("_bucket").alias("at"))))))
    order = Window.partitionBy("_to.at").orderBy(F.desc("_to.own"), F.desc("_key"), "_tie")
    dealt = dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried])
    return dealt.where("_to.own").drop("_to", "_bucket", "_top", "_top_tie", "_before", "_key")


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id and fingerprint (array of struct(hash, position)) of each row.

    Null texts have the empty fingerprint of an empty text; an empty table gives none; repeated rows
    have one each. Long texts are read in stretches of 32,768 windows. Other columns are not carried.
    """
    shown = lambda e: F.struct(hash_of(e).alias("hash"), position(e).cast("int").alias("position"))
    return docs.select("doc_id", F.transform(chosen(F.coalesce("text", F.lit("")), k, w), shown).alias("fingerprint"))


def compared(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Each row's fingerprint beside that of its edited text and of the next document.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next document, by descending doc_id; after the last comes the first, a single row
    follows itself. Rows with the same doc_id follow in order of a hash of their texts, repeated rows
    one upon the other. Null doc_ids come last. Null texts are empty. Long texts are read in
    stretches, ids of many rows are split. An empty table gives an empty result; other columns are
    not carried, whatever their names.
    """
    rows = common.spread(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).withColumn("_tie", F.sha1("text"))
    repeated = bool(rows.groupBy("doc_id", "_tie").count().where("count > 1").limit(1).count())
    if repeated:
        rows = rows.groupBy("doc_id", "_tie").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    rows = rows.withColumn("packed", once(chosen(F.col("text"), k, w), lambda fp: packed(fp, F.length("text"))))
    rows = followed(rows, ["text", "packed"])
    if repeated:  # all copies but the last are followed by a copy
        copies = rows.where("copies > 1").withColumns({"next_text": F.col("text"), "next_packed": F.col("packed")})
        rows = rows.unionByName(copies.withColumn("copies", F.explode(F.sequence(F.lit(2).cast("long"), F.col("copies")))))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (n - half).cast("int")), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("fp", unpacked(F.col("packed"))).withColumn("next_fp", unpacked(F.col("next_packed")))
    rows = rows.withColumn("edited", edited).withColumn("own", hashes_of(F.col("fp")))
    rows = rows.withColumn("efp", chosen_after_edit(F.col("fp"), F.col("edited"), n - half, k, w))
    return rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), printed(F.col("fp")).alias("fingerprint"), printed(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("own"), hashes_of(F.col("efp"))).alias("near_edited"), likeness(F.col("own"), hashes_of(F.col("next_fp"))).alias("near_next"),
    )
