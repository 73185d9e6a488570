"""MinHash near-duplicates by an inverted join on signature coordinates.

Documents of equal shingle sets form a class. Each class posts its signature's (coordinate, value)
pairs. A pair of classes that agrees in at least `least` of `size` coordinates must share one of
the size - least + 1 rarest pairs of either; only these prefixes are joined, and a class with too
few pairs that any other class has is skipped altogether. Within a posting list, members are first
matched with one pivot; lists whose members are then in one component are skipped, and only what
is left across components is compared in blocks, counting agreeing coordinates. Every candidate is
confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

SHINGLE = 5
_LUT = np.arange(256, dtype=np.uint8)
_LUT[65:91] += 32
_BASE, _STEP = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of a public hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base modulo 2**64, and of its inverse."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            column = np.full(size, base, np.uint64)
            column[0] = 1
            _powers[name] = np.cumprod(column)
    return _powers["up"][:n], _powers["down"][:n]


def shingles(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within the text, and the n+1 offsets of the texts in them.

    Words are runs of bytes other than space and 0x09-0x0D, A-Z lower-cased; a text of fewer than
    five words has one shingle of all of them, a text without words none.
    """
    n = len(at) - 1
    b = _LUT[raw]
    gap = (b == 32) | ((b >= 9) & (b <= 13))
    first = np.zeros(len(b) + 1, bool)
    first[at] = True  # a text begins or all ends here
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    before = np.concatenate([[True], gap[:-1]])
    start = np.flatnonzero(~gap & (before | first[:-1]))
    after = np.concatenate([gap[1:], [True]])
    end = np.flatnonzero(~gap & (after | first[1:])) + 1
    up, down = powers(len(b) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:-1])])
    word = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(_STEP))
    words = np.searchsorted(start, at)  # offsets of the texts in the words
    count = np.diff(words)
    made = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(n), made)
    offset = np.cumsum(made) - made
    begin = words[owner] + np.arange(len(owner)) - offset[owner]
    length = np.minimum(count, SHINGLE)[owner]
    value = np.zeros(len(owner), np.uint64)
    for j in range(SHINGLE):
        there = length > j
        value = np.where(there, value * np.uint64(_STEP) + word[np.minimum(begin + j, max(len(word) - 1, 0))] if len(word) else value, value)
    value = mix(value + length.astype(np.uint64))
    order = np.lexsort((value, owner))
    value = value[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])  # owner is sorted already
    return value[fresh], np.concatenate([[0], np.cumsum(np.bincount(owner[fresh], minlength=n))])


def signatures(values: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """(texts, size) tokens of coordinate and least value; -1 for texts without shingles."""
    factor = np.random.default_rng(11).integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.full((len(at) - 1, size), -1, np.int64)
    some = np.flatnonzero(np.diff(at))
    for k in range(size if len(some) else 0):
        least = np.minimum.reduceat((values * factor[k]) >> np.uint64(32), at[some])
        out[some, k] = (least | np.uint64(k << 32)).astype(np.int64)
    return out


def signed(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, a hash of the text, n_shingles, two hashes of the set, and the signature of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "text"):
                values, at = shingles(*common.text_buffers(batch.column("text")))
                n = np.diff(at)
                tokens = signatures(values, at, size)
                sums = []
                for salt in (1, 2):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values * np.uint64(2) + np.uint64(salt)))])
                    sums.append(pa.array((total[at[1:]] - total[at[:-1]]).astype(np.int64)))
                lists = pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * size, pa.array(tokens.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(n), *sums, lists], ["doc_id", "row", "n_shingles", "h1", "h2", "sig"])

    rows = common.spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text"))
    return rows.mapInArrow(run, "doc_id long, row long, n_shingles long, h1 long, h2 long, sig array<long>")


def common_counts(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of the i-th set of a and of b."""
    n = len(a[1]) - 1
    owner = np.concatenate([np.repeat(np.arange(n), np.diff(x[1])) for x in (a, b)])
    value = np.concatenate([a[0], b[0]])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    same = (value[1:] == value[:-1]) & (owner[1:] == owner[:-1])
    return np.bincount(owner[1:][same], minlength=n)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full shingle sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "text_a", 1 << 20):
                sides = [shingles(*common.text_buffers(batch.column(c))) for c in ("text_a", "text_b")]
                both = common_counts(*sides)
                union = np.diff(sides[0][1]) + np.diff(sides[1][1]) - both
                good = pa.array(100 * both >= percent * union)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], ["a", "b"])

    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """id and component (smallest id reachable) of every id that has an edge (a, b).

    Every id takes the smallest id around it, edges move to what their ends took, and so on until
    none is left; then ids follow what they took to the end. All steps are joins of edges.
    """
    edges = common.cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    steps = []
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        took = common.cut(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("to")))
        steps.append(took)
        ends = edges
        for end in ("a", "b"):
            ends = ends.join(took.select(F.col("a").alias(end), F.col("to").alias(f"{end}2")), end)
        edges = common.cut(ends.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).where("a <> b").distinct())
    if not steps:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    found = steps[0].select(F.col("a").alias("id"), F.col("to").alias("component"))
    for took in steps[1:]:
        found = found.join(took.select(F.col("a").alias("component"), "to"), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    # an id may point to one that itself took a smaller one in the same step
    while True:
        up = found.select(F.col("id").alias("component"), F.col("component").alias("top"))
        found = common.cut(found.join(up, "component", "left").select("id", F.coalesce("top", "component").alias("component"), (F.coalesce("top", "component") < F.col("component")).alias("moved")))
        if not found.where("moved").limit(1).count():
            return found.select("id", "component")


def labels(links: DataFrame) -> DataFrame:
    """id and component of every id that has a link (a, b): the smallest id within two links. Ids of one label are connected; not the reverse."""
    both = common.cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    near = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("to"))
    next_to = both.join(near.select(F.col("a").alias("b"), F.col("to").alias("far")), "b").groupBy("a").agg(F.min("far").alias("far"))
    return common.cut(near.join(next_to, "a").select(F.col("a").alias("id"), F.least("to", "far").alias("component")))


def shingle_sets(texts: DataFrame) -> DataFrame:
    """id and the sorted shingle hashes of each (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "text"):
                values, at = shingles(*common.text_buffers(batch.column("text")))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(at.astype(np.int32), pa.array(values.astype(np.int64)))], ["id", "set"])

    return texts.mapInArrow(run, "id long, set array<long>")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """(left, right) sizes of the intersections of sets, as products of incidence matrices over the values that occur on both sides."""
    flat = [np.concatenate([np.zeros(0, np.int64), *side]) for side in (left, right)]
    both = np.intersect1d(*flat)
    out = np.zeros((len(left), len(right)), np.float32)
    places = []
    for side, values in zip((left, right), flat, strict=True):
        owner = np.repeat(np.arange(len(side)), [len(x) for x in side])
        at = np.searchsorted(both, values)
        known = (at < len(both)) & (both[np.minimum(at, max(len(both) - 1, 0))] == values) if len(both) else np.zeros(len(values), bool)
        places.append((owner[known], at[known]))
    for start in range(0, len(both), width):
        sides = []
        for side, (owner, at) in zip((left, right), places, strict=True):
            here = (at >= start) & (at < start + width)
            matrix = np.zeros((len(side), min(width, len(both) - start)), np.float32)
            matrix[owner[here], at[here] - start] = 1
            sides.append(matrix)
        out += sides[0] @ sides[1].T
    return np.rint(out).astype(np.int64)


def across(members: DataFrame, least: int, size: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between members (token, blocks, id, component, mask, sig, set) of posting lists that are of different components.

    mask: bits of the coordinates that an id posts. blocks: how many parts a list is cut into; each
    pair of parts is compared by one task: agreeing coordinates are
    counted, pairs with at least `least` of them are confirmed on their full sets, and one link for
    each pair of components leaves the task. A pair is looked at in the list of the first coordinate
    only that both post and agree in.
    """
    rows = members.withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "component", "mask", "sig", "set")
    rows = rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "own", "id")

    def match(token, own, ids, parts, mask, sig, sets) -> Iterator[tuple[int, int]]:
        places, here = np.uint64(1) << np.arange(size, dtype=np.uint64), np.uint64(1 << (int(token) >> 32))
        one = own[0] == own[-1]
        left = np.arange(len(own)) if one else np.flatnonzero(own == own[0])
        right = left if one else np.flatnonzero(own != own[0])
        linked = set()
        for p in range(0, len(left), 64):
            x = left[p : p + 64]
            same = sig[x][:, None, :] == sig[right][None]
            agreed = np.where(same, places, np.uint64(0)).sum(2, dtype=np.uint64) & mask[x][:, None] & mask[right][None]
            good = (same.sum(2) >= least) & (parts[x][:, None] != parts[right][None]) & ((agreed & (~agreed + np.uint64(1))) == here)
            if one:
                good &= ids[x][:, None] < ids[right][None]
            some, others = np.flatnonzero(good.any(1)), np.flatnonzero(good.any(0))
            if not len(some):
                continue
            a, b = [sets[k] for k in x[some]], [sets[k] for k in right[others]]
            both = shared_counts(a, b)
            union = np.array([len(v) for v in a])[:, None] + np.array([len(v) for v in b])[None] - both
            for i, j in zip(*np.nonzero(good[np.ix_(some, others)] & (100 * both >= percent * union)), strict=True):
                k, m = x[some[i]], right[others[j]]
                pair = (min(parts[k], parts[m]), max(parts[k], parts[m]))
                if pair not in linked:
                    linked.add(pair)
                    yield int(ids[k]), int(ids[m])

    def flush(table: pa.Table) -> pa.RecordBatch:
        key = np.stack([table.column(c).to_numpy() for c in ("token", "i", "j")])
        cut = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, [table.num_rows]])
        own, ids, parts, mask = (table.column(c).to_numpy() for c in ("own", "id", "component", "mask"))
        sig = table.column("sig").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        held = table.column("set").combine_chunks()
        at, flat = held.offsets.to_numpy(), held.values.to_numpy()
        sets = [flat[s:e] for s, e in zip(at, at[1:], strict=False)]
        mask = mask.astype(np.uint64)
        pairs = [x for s, e in zip(cut, cut[1:], strict=False) if e - s > 1 for x in match(key[0, s], own[s:e], ids[s:e], parts[s:e], mask[s:e], sig[s:e], sets[s:e])]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            table = pa.Table.from_batches([b])
            table = table if held is None else pa.concat_tables([held, table])
            if not table.num_rows:
                continue
            key = np.stack([table.column(c).to_numpy() for c in ("token", "i", "j")])
            last = np.flatnonzero((key != key[:, -1:]).any(0))
            whole = int(last[-1]) + 1 if len(last) else 0  # the last group may go on in the next batch
            if whole:
                yield flush(table.slice(0, whole))
            held = table.slice(whole)
        if held is not None and held.num_rows:
            yield flush(held)

    return rows.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, percent: int = 75, size: int = 48, least: int = 24, block: int = 1024, most_broadcast: int = 1_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs (doc_id, text).

    Rows are linked if 100 * intersection >= percent * union of their sets of five-word shingles;
    component_id is the smallest doc_id that links lead to. Null, empty and blank texts have no
    shingles and no links. Rows with the same doc_id are one document if they are linked, and share
    a component in any case; a null doc_id has no links, a null component_id and is kept. An empty
    table gives an empty result; other columns are not carried, whatever their names. A long text is
    hashed whole, with memory in proportion to it. Two texts at the bound agree in
    fewer than `least` of `size` coordinates with probability below 1e-4.
    """
    rows = common.table(signed(docs, size), "signatures")
    known = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").withColumn("id", F.xxhash64("n_shingles", "h1", "h2"))
    classes = known.groupBy("id").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.first("sig").alias("sig"))
    classes = common.table(classes.select("id", "first.doc_id", "first.row", "sig"), "classes")
    posts = classes.select("id", F.explode("sig").alias("token"))
    counts = posts.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = posts.join(counts, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))  # at most `size` entries
    prefix = shared.where(F.size("shared") >= least).withColumn("weight", F.aggregate("shared", F.lit(0).cast("bigint"), lambda a, x: a + x["df"]))
    prefix = prefix.select("id", "weight", F.explode(F.slice("shared", F.lit(1), F.size("shared") - (least - 1))).alias("p")).select("id", "weight", F.col("p.token").alias("token"))
    prefix = common.table(prefix, "prefixes")
    picked = common.cut(classes.join(prefix.select("id").distinct(), "id", "left_semi"))
    wanted = picked.select("doc_id", "row", "id")
    if picked.count() <= most_broadcast:  # 24 bytes each; a shuffled join beyond
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text").join(wanted, ["doc_id", "row"]).select("id", "text")
    texts = common.table(texts, "candidates")
    sigs = picked.select("id", "sig")

    def alike(pairs: DataFrame) -> DataFrame:
        met = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b")
        return met.where(F.size(F.array_intersect("sig_a", "sig_b")) >= least).select("a", "b")

    # the pivot of a list is its member whose values are the most frequent ones: of a family of copies, one near the original
    rank = F.struct(F.col("weight"), F.xxhash64("id"), F.col("id").alias("a"))
    pivots = prefix.groupBy("token").agg(F.max(rank).alias("p")).select("token", F.col("p.a").alias("a"))
    pairs = prefix.join(pivots, "token").where("id <> a").select("a", F.col("id").alias("b")).distinct()
    links = common.cut(confirmed(alike(pairs), texts, percent))
    # what is left across components, with full sets only where a list has several
    members = prefix.drop("weight").join(labels(links), "id", "left").withColumn("component", F.coalesce("component", "id"))
    lists = members.groupBy("token").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    lists = common.cut(lists.select("token", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    members = common.cut(members.join(F.broadcast(lists) if lists.count() <= most_broadcast else lists, "token"))
    posted = prefix.groupBy("id").agg(F.bit_or(F.expr("shiftleft(1L, CAST(token >> 32 AS int))")).alias("mask"))
    needed = members.select("id").distinct().join(posted, "id").join(sigs, "id")
    needed = needed.join(shingle_sets(texts.join(members.select("id").distinct(), "id", "left_semi")), "id").dropDuplicates(["id"])
    rest = common.cut(across(members.join(needed, "id"), least, size, percent))
    parts = components(links.unionByName(rest))

    # every doc_id by its classes; one that is in classes of several components joins these
    placed = known.select("doc_id", "id").join(parts, "id", "left").select("doc_id", F.coalesce("component", "id").alias("part")).distinct()
    placed = common.cut(placed)
    spans = placed.groupBy("doc_id").agg(F.min("part").alias("part"), F.max("part").alias("other"))
    split = placed.withColumnRenamed("part", "b").join(spans.where("part <> other").select("doc_id", F.col("part").alias("a")), "doc_id").select("a", "b")
    final = spans.select("doc_id", "part")
    if split.limit(1).count():
        joined = components(split).select(F.col("id").alias("part"), "component")
        final = final.join(joined, "part", "left").select("doc_id", F.coalesce("component", "part").alias("part"))
    named = final.groupBy("part").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    final = final.join(named, "part").select("doc_id", "component_id")
    out = rows.select("doc_id", "n_shingles").join(final, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT r.d, e.b FROM r JOIN e ON r.c = e.a)
SELECT d AS doc_id, coalesce(max(n), 0) AS n_shingles, min(c) AS component_id, d = min(c) AS kept FROM r LEFT JOIN n ON n.doc_id = d GROUP BY d
"""
