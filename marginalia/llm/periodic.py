"""Periodic runs of words: found by matching blocks, extended exactly, and collapsed.

A run is a stretch of words with a smallest period q, at least twice as long, that no neighbouring
word extends. For each power of two b, the document is cut into aligned blocks of b words. Of a run
with 2b-1 <= q <= 4b-2 one aligned block lies in its first length-q words and comes again q words later,
so that all periods are found by looking, for each b, for copies of blocks at those distances. Blocks
are sequences of word numbers in an Aho-Corasick automaton, one size at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

RESULT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string"


def gaps(ids: np.ndarray) -> np.ndarray:
    """How far behind each word the same word comes again; more than the document's length, if it does not."""
    out = np.full(len(ids), len(ids) + 1, np.int64)
    order = np.argsort(ids, kind="stable")
    same = ids[order[:-1]] == ids[order[1:]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def stretch(ids: np.ndarray, at: int, end: int, q: int) -> tuple[int, int]:
    """The longest range around [at, end) in which every word comes again q words later."""
    step, n = 16, len(ids) - q
    while end < n:
        upto = min(n, end + step)
        differ = ids[end:upto] != ids[end + q : upto + q]
        k = int(differ.argmax())
        if differ[k]:
            end += k
            break
        end, step = upto, step * 2
    step = 16
    while at > 0:
        down = max(0, at - step)
        differ = ids[down:at] != ids[down + q : at + q]
        k = int(differ[::-1].argmax())
        if differ[len(differ) - 1 - k]:
            at -= k
            break
        at, step = down, step * 2
    return at, end


def copies(ids: np.ndarray, blocks: np.ndarray, b: int, low: int, high: int) -> Iterator[tuple[int, int]]:
    """(block, distance) of all copies of the blocks that begin at the given places, low to high words behind them."""
    starts: dict[tuple[int, ...], list[int]] = {}
    for a in blocks.tolist():
        starts.setdefault(tuple(ids[a : a + b].tolist()), []).append(a)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key, places in starts.items():
        automaton.add_word(key, places)
    automaton.make_automaton()
    # only what lies within reach of a block is searched; reaches that overlap are searched once
    first, last = blocks + low, np.minimum(blocks + high + b, len(ids))
    heads = np.flatnonzero(np.concatenate([[True], first[1:] > last[:-1]]))
    tails = np.append(heads[1:] - 1, len(blocks) - 1)
    for begin, end in zip(first[heads].tolist(), last[tails].tolist(), strict=True):
        for at, places in automaton.iter(tuple(ids[begin:end].tolist())):
            place = begin + at - b + 1
            for a in places if len(places) == 1 else _within(places, place - high, place - low):
                if low <= place - a <= high:
                    yield a, place - a


def _within(places: list[int], low: int, high: int) -> list[int]:
    from bisect import bisect_left, bisect_right

    return places[bisect_left(places, low) : bisect_right(places, high)]


def runs_of(ids: np.ndarray, least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least `least` words and twice their smallest period, by start, then period."""
    n = len(ids)
    if n < least:
        return []
    apart = gaps(ids)
    found: dict[tuple[int, int], int] = {}
    seen: dict[int, tuple[int, int]] = {}
    b = 1
    while 2 * (2 * b - 1) <= n:
        low, high = 2 * b - 1, min(4 * b - 2, n // 2)
        # a block can only have a copy in reach if each of its words comes again in reach
        size = n // b * b
        alive = (apart[:size] <= high).reshape(-1, b).all(1)
        blocks = np.flatnonzero(alive) * b
        if len(blocks):
            # within a run of a period of at most b nothing else is to be found: its multiples only
            reach = np.zeros(n + 1, np.int64)
            for (start, end), period in found.items():
                if period <= b:
                    reach[start] = max(reach[start], end)
            reach = np.maximum.accumulate(reach)
            blocks = blocks[(blocks + low + b <= n) & (reach[blocks] < np.minimum(blocks + high + b, n))]
        if len(blocks):
            for a, q in copies(ids, blocks, b, low, high):
                if reach[a] >= a + q + b:
                    continue
                known = seen.get(q)
                if known and known[0] <= a and a + q + b <= known[1]:
                    continue
                start, end = stretch(ids, a, a + b, q)
                end += q
                seen[q] = (start, end)
                if end - start >= max(least, 2 * q):
                    found[start, end] = min(q, found.get((start, end), q))
        b *= 2
    return sorted(((start, end - start, q) for (start, end), q in found.items()), key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay when each run keeps its first period only (a word that any run drops goes)."""
    keep = np.ones(n, bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return keep


def collapse(docs: DataFrame, least: int = 12) -> DataFrame:
    """doc_id, n_words, runs (structs of start, length and period, by start, then period) and text (the kept words, joined by one space).

    Words are what lies between ASCII white space. Null, empty and blank texts have no words, no runs and
    an empty text. Of equally long runs at one place the smallest period counts. Repeated rows and rows
    of null doc_ids are judged each; an empty table gives an empty result; other columns are not carried,
    whatever their names. A task holds one document's words and one automaton of as many words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "text"):
                counts, lists, texts = [], [], []
                for text in batch.column("text").cast(pa.binary()).to_pylist():
                    words, numbers = (text or b"").split(), {}
                    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
                    found = runs_of(ids, least) if len(numbers) < len(words) else []
                    if found:
                        keep = kept_words(len(words), found)
                        words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                    counts.append(len(ids))
                    lists.append(found)
                    texts.append(b" ".join(words))
                flat = np.array(list(chain.from_iterable(lists)), np.int64).reshape(-1, 3)
                structs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
                offsets = pa.array(np.cumsum([0, *map(len, lists)]).astype(np.int32))
                columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(offsets, structs), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "text"])

    return common.spread(docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "text")).mapInArrow(run, RESULT)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, in about every tenth document (by a checksum of its id) with words that repeat from a place on.

    With h the CRC-32 of the decimal doc_id and g = floor(h / 10), in documents with h % 10 = 0 and n > 0 words
    each word i >= a becomes word a + (i - a) % p, where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)).
    Rows of null doc_ids stay as they are.
    """
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    code = F.crc32(F.encode(F.col("doc_id").cast("bigint").cast("string"), "UTF-8"))
    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", (code % 10 == 0).alias("chosen"), F.floor(code / 10).alias("g"))
    chosen = chosen.withColumn("words", F.when(F.col("chosen"), words)).withColumn("n", F.size("words").cast("long"))
    chosen = chosen.withColumn("a", F.expr("CASE WHEN n > 0 THEN g % n END")).withColumn("p", F.expr("1 + (n - a) DIV (3 + g % 8)"))
    repeated = F.expr("array_join(transform(words, (w, i) -> CASE WHEN i < a THEN w ELSE words[CAST(a + (i - a) % p AS int)] END), ' ')")
    return chosen.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def described(collapsed: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period and exponent_milli, null without one) and checksums of all runs and of the collapsed text."""
    longest = F.expr("array_sort(runs, (x, y) -> CASE WHEN x.length <> y.length THEN CAST(sign(y.length - x.length) AS int) WHEN x.start <> y.start THEN CAST(sign(x.start - y.start) AS int) ELSE CAST(sign(x.period - y.period) AS int) END)")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    best = collapsed.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.get(longest, F.lit(0)).alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    exponent = F.expr("1000 * best.length DIV best.period")
    return best.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
