"""Packing along a space-filling curve.

Each document's token ids are hashed to a vector, which is projected to a few dimensions; its cell
there gives a Hilbert key. Rows are sorted by ranges of that key, cut by their tokens, and each range is cut into
sequences in order, so that neighbours on the curve share sequences. Sequences hold seq_len tokens
and no padding; what is left at the end of a range goes into sequences of powers of two, which
need no padding either.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

#: Appended to each document.
END_ID = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@functools.cache
def coding_of(vocabulary: str):
    """A fast encoder with the vocabulary, merges and special tokens of a `tokenizers` file of byte-level BPE.

    In such a file the id of a piece is its rank, which is checked; the strings of special tokens in
    a text get their ids, as `tokenizers` does it.
    """
    import tiktoken

    from public_tokenizers import PATTERN

    with open(vocabulary, encoding="utf-8") as f:
        held = json.load(f)
    shown = [b for b in range(256) if chr(b).isprintable() and b not in (32, 173)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"]: t["id"] for t in held["added_tokens"]}
    ids = {p: i for p, i in held["model"]["vocab"].items() if p not in special}
    pairs = (m if isinstance(m, list) else m.split(" ") for m in held["model"]["merges"])
    made = [ids[a + b] for a, b in pairs]
    if made != sorted(made):
        raise ValueError(f"{vocabulary}: ids are not in the order of merges")
    return tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks={bytes(byte_of[c] for c in p): i for p, i in ids.items()}, special_tokens=special)


class ByteEncoder:
    """Ids of a byte-level BPE as packed little-endian integers; null gives none."""

    def __init__(self, vocabulary: str):
        self.coding = coding_of(vocabulary)
        self.n_vocab = self.coding.max_token_value + 1
        self.dtype = np.dtype("<u2" if self.n_vocab <= 1 << 16 else "<u4")

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        code = "H" if self.dtype.itemsize == 2 else "I"
        return [array(code, self.coding.encode(t, allowed_special="all", disallowed_special=())).tobytes() if t else b"" for t in texts]


def projection(n_vocab: int, dims: int, seed: int = 7) -> np.ndarray:
    """Random signs for each id and dimension: the projection of a document's hashed counts is their sum."""
    return np.random.default_rng(seed).integers(0, 2, (dims, n_vocab)).astype(np.float32) * 2 - 1


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert keys of integer points (dims, n), by Skilling's transposition, as int64."""
    x = cells.astype(np.int64).copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[dims - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def tokenized(docs: DataFrame, vocabulary: str, dims: int = 3, bits: int = 16) -> DataFrame:
    """doc_id, ids (packed, with the end id), doc_tokens, the Hilbert key and a number of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ByteEncoder(vocabulary)
        signs, end = projection(coder.n_vocab, dims), np.array([END_ID], coder.dtype).tobytes()
        for whole in batches:
            for batch in common.slices(whole, "text"):
                ids = [x + end for x in coder.encode_batch(batch.column("text").to_pylist())]
                n = np.array([len(x) // coder.dtype.itemsize for x in ids], np.int64)
                flat, starts = np.frombuffer(b"".join(ids), coder.dtype), np.cumsum(n) - n
                means = np.stack([np.add.reduceat(s[flat], starts) for s in signs]) / n
                cells = np.minimum(((np.tanh(4 * means) + 1) * (1 << (bits - 1))).astype(np.int64), (1 << bits) - 1)
                columns = [batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(n), pa.array(hilbert(cells, bits)), batch.column("row")]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "doc_tokens", "key", "row"])

    rows = common.spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).withColumn("row", F.monotonically_increasing_id())
    return rows.mapInArrow(run, "doc_id long, ids binary, doc_tokens long, key long, row long")


def pieces_of(rows: Iterator[tuple], first_sequence: int, seq_len: int, dtype: np.dtype) -> Iterator[tuple]:
    """Pieces (with their ids) of (doc_id, packed ids) rows, cut in order into full sequences and a tail in powers of two."""
    sequence, used, pending = first_sequence, 0, []
    for doc_id, packed in rows:
        ids, start = np.frombuffer(packed, dtype), 0
        while start < len(ids):
            length = min(len(ids) - start, seq_len - used)
            piece = (doc_id, start, length, len(ids), used, ids[start : start + length])
            used, start = used + length, start + length
            if used < seq_len:
                pending.append(piece)
                continue
            for p in [*pending, piece]:
                yield (*p, sequence)
            sequence, used, pending = sequence + 1, 0, []
    room, filled = 1 << used.bit_length() >> 1, 0  # the largest power of two that the tail fills
    for doc_id, start, length, total, _, ids in pending:
        while length:
            take = min(length, room - filled)
            yield doc_id, start, take, total, filled, ids[:take], sequence
            start, length, filled, ids = start + take, length - take, filled + take, ids[take:]
            if filled == room:
                used -= room
                sequence, filled, room = sequence + 1, 0, 1 << used.bit_length() >> 1


#: Order of rows along the curve; null doc_ids come first, and repeated rows are told apart by their number.
ORDER = ["key", "doc_id", "row"]


def token_bounds(rows: DataFrame, tokens_per_part: int) -> list[tuple]:
    """The ORDER columns of the first row of each part but the first, of parts of about tokens_per_part tokens.

    Only narrow rows are sorted; each partition then finds its own bounds from the tokens before it.
    The driver holds one row a partition and one a part, as a range partitioning does.
    """
    narrow = common.cut(rows.select(*ORDER, "doc_tokens").repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).withColumn("at", F.spark_partition_id()))
    before, total = {}, 0
    for r in narrow.groupBy("at").agg(F.sum("doc_tokens").alias("n")).orderBy("at").collect():
        before[r["at"]], total = total, total + r["n"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, last = None, None
        for b in batches:
            if not b.num_rows:
                continue
            if seen is None:
                seen = before[b.column("at")[0].as_py()]
                last = -1 if seen == 0 else (seen - 1) // tokens_per_part
            ends = seen + np.cumsum(b.column("doc_tokens").to_numpy())
            part = (ends - 1) // tokens_per_part  # a document belongs to the part in which it ends
            new = np.flatnonzero(np.diff(part, prepend=last))
            seen, last = int(ends[-1]), int(part[-1])
            yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(new)) for c in ORDER], ORDER)

    found = narrow.mapInArrow(find, "key long, doc_id long, row long").collect()
    return sorted((r["key"], -(1 << 63) if r["doc_id"] is None else r["doc_id"], r["row"]) for r in found)[1:]


def dealt(rows: DataFrame, bounds: list[tuple]) -> DataFrame:
    """rows (with ORDER) and the number of their part, each part in a partition of its own, sorted."""
    limits = np.array(bounds, np.int64).reshape(-1, 3)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, row = b.column("key").to_numpy(), b.column("row").to_numpy()
            doc = b.column("doc_id").fill_null(-(1 << 63)).to_numpy()
            low, high = np.searchsorted(limits[:, 0], key, "left"), np.searchsorted(limits[:, 0], key, "right")
            part = high.astype(np.int32)
            for i in np.flatnonzero(low < high):  # bounds of the same key: the other columns decide
                part[i] = low[i] + bisect.bisect_right(limits[low[i] : high[i], 1:].tolist(), [int(doc[i]), int(row[i])])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part)], [*b.schema.names, "part"])

    placed = rows.mapInArrow(place, "doc_id long, ids binary, doc_tokens long, key long, row long, part int")
    return placed.repartitionById(len(limits) + 1, F.col("part")).sortWithinPartitions("part", *ORDER)


def pack(docs: DataFrame, vocabulary: str | None = None, seq_len: int = 2048, tokens_per_part: int = 1 << 24, with_ids: bool = False) -> DataFrame:
    """The pieces of all rows of documents (doc_id, text), each id in exactly one piece.

    A null or empty text is the end id alone. Rows with the same doc_id are documents of their own;
    a null doc_id stays null. Equal texts are neighbours, in order of doc_id. Ranges of the curve hold
    about tokens_per_part tokens, however long their documents are; a longer document is a range of
    its own, held by one task with its ids alone (2 bytes each). An empty table gives no pieces; other columns are
    not carried, whatever their names. with_ids adds the ids of each piece.
    """
    import public_tokenizers

    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    rows = common.table(tokenized(docs, vocabulary), "ids")
    ranged = dealt(rows, token_bounds(rows, tokens_per_part))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = ByteEncoder(vocabulary).dtype
        names = [x.split()[0] for x in PIECES.split(", ")]
        rows = (r for b in batches for r in zip(b.column("part").to_pylist(), b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True))

        def batch(made: list) -> pa.RecordBatch:
            columns = [pa.array(list(c), pa.int64()) for c in zip(*[m[:7] for m in made], strict=True)]
            if with_ids:
                columns.append(pa.array([m[7] for m in made], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(columns, [*names, "ids"] if with_ids else names)

        made = []
        for part, own in itertools.groupby(rows, lambda r: r[0]):
            for doc_id, start, length, total, offset, ids, sequence in pieces_of((r[1:] for r in own), part << 36, seq_len, dtype):
                crc = zlib.crc32(ids.astype("<u4").tobytes())
                made.append((doc_id, start, length, crc, total, sequence, offset, *([ids.astype(np.int32)] if with_ids else [])))
                if len(made) == 8192:
                    yield batch(made)
                    made = []
        if made:
            yield batch(made)

    return ranged.select("part", "doc_id", "ids").mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))
