"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

The merges give every byte prefix of a piece one encoding. Its last token is the only token that ends
there and may follow the last token of the prefix before it; whether two tokens may stand side by side
depends on them alone. So one token a byte says the encoding of every prefix: appended bytes never
change what is stored, and an edit leaves what lies before it, and all pieces behind the place where
the old and the new split meet again.

Texts are split into pieces by the pattern of the vocabulary. Which characters are letters, digits and
spaces is asked of the library whose ids are to be met, as tables of characters differ by versions.
"""

from __future__ import annotations

import base64
import bisect
import functools
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

DTYPE = np.dtype("<u4")
NEVER = 1 << 40
START = -1
#: Characters that stand for one whose class differs between the two libraries.
STAND_INS = {"letter": "a", "digit": "1", "space": " ", "other": "\ue000"}
#: The pattern of the vocabularies at hand with the alternatives of words first: they begin with other characters than the marks, and are by far the most.
PATTERN = r" ?\p{L}+| ?\p{N}+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: How far behind its start a match of the pattern can look (a mark and two letters).
LOOKS = 3


class Vocabulary:
    """Tokens by rank, and which two may be neighbours; one object for each process and file."""

    _loaded: dict[str, Vocabulary] = {}

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary has a token for every byte")
        self.bytes_of: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        # every end of a token, with its rank or None
        self.endings: dict[bytes, int | None] = dict.fromkeys(t[k:] for t in self.ranks for k in range(1, len(t)))
        self.endings |= self.ranks
        self.halves: dict[int, tuple[int, int]] = {}
        self.allowed: dict[int, bool] = {}

    @classmethod
    def of(cls, path: str) -> Vocabulary:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes a token; None for a byte, and for one that no merge makes."""
        found = self.halves.get(token, 0)
        if found == 0:
            whole = self.bytes_of[token]
            pieces = [self.ranks[whole[i : i + 1]] for i in range(len(whole))]
            while len(pieces) > 2:
                pairs = [self.ranks.get(self.bytes_of[a] + self.bytes_of[b], NEVER) for a, b in zip(pieces, pieces[1:], strict=False)]
                least = min(pairs)
                if least >= token:
                    break
                at = pairs.index(least)
                pieces[at : at + 2] = [least]
            found = self.halves[token] = (pieces[0], pieces[1]) if len(pieces) == 2 else None
        return found

    def edge(self, token: int, right: bool) -> list[tuple[int, int]]:
        """The tokens that stand at a token's right (left) end while it is being merged, each with the rank of the merge that takes it away."""
        chain, gone = [], NEVER
        while True:
            chain.append((token, gone))
            parts = self.parts(token)
            if parts is None:
                return chain
            gone, token = token, parts[1 if right else 0]

    def follows(self, before: int, token: int) -> bool:
        """Whether the bytes of two tokens side by side are encoded as just these two.

        They are not, if a merge across the boundary comes while both of its sides stand there. Of
        merges of one rank the left one comes first. Before the first token of a piece stands START.
        """
        known = len(self.bytes_of[token]) == 1 or self.parts(token) is not None
        if known and before != START:
            rights = self.edge(token, False)
            for left, left_gone in self.edge(before, True):
                head = self.bytes_of[left]
                if any((rank := self.ranks.get(head + self.bytes_of[right])) is not None and rank < left_gone and rank <= right_gone for right, right_gone in rights):
                    known = False
                    break
        if len(self.allowed) >= 4_000_000:
            self.allowed.clear()
        self.allowed[before << 32 | token] = known
        return known


class Prefixes:
    """A piece of bytes that grows at its end, with the last token of each of its prefixes (START for none)."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", [START]
        if data:
            self.append(data)

    def append(self, more: bytes) -> None:
        data, last, add = self.data + more, self.last, self.last.append
        ending, allowed, follows = self.v.endings.get, self.v.allowed.get, self.v.follows
        for end in range(len(self.data) + 1, len(data) + 1):
            at = end
            while True:
                at -= 1
                token = ending(data[at:end], -1)
                if token is not None:
                    if token < 0 or at < 0:
                        raise ValueError("no token ends here")
                    before = last[at]
                    known = allowed(before << 32 | token)
                    if known or known is None and follows(before, token):
                        add(token)
                        break
        self.data = data

    def prefix(self, size: int) -> Prefixes:
        """The first bytes as a piece of their own, with what is stored of them."""
        out = Prefixes(self.v)
        out.data, out.last = self.data[:size], self.last[: size + 1]
        return out

    def ids(self, size: int | None = None) -> list[int]:
        """Tokens of the prefix of so many bytes (the whole)."""
        end, out, last, bytes_of = len(self.data) if size is None else size, [], self.last, self.v.bytes_of
        while end:
            token = last[end]
            out.append(token)
            end -= len(bytes_of[token])
        out.reverse()
        return out


@functools.cache
def splitter(pattern: str):
    """A function that gives the pieces of a text.

    Characters whose class differs between the library and the module that splits here are split as
    another one of the library's class.
    """
    import regex
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    one_byte = {bytes([b]): b for b in range(256)}
    stands: dict[str, str] = {}
    for name, kind in (("letter", r"\p{L}"), ("digit", r"\p{N}"), ("space", r"\s")):
        theirs = bytes(tiktoken.Encoding(name, pat_str=kind, mergeable_ranks=one_byte, special_tokens={}).encode_ordinary(every)).decode()
        ours = regex.sub(f"[^{kind}]", "", every)
        if ours != theirs:
            ours, theirs = set(ours), set(theirs)
            stands = dict.fromkeys(ours - theirs, STAND_INS["other"]) | stands | dict.fromkeys(theirs - ours, STAND_INS[name])
    odd = re.compile("[" + "".join(f"\\U{ord(a):08x}-\\U{ord(b):08x}" for a, b in _ranges(stands)) + "]") if stands else None
    found = regex.compile(pattern)

    def split(text: str) -> list[str]:
        alike = odd.sub(lambda m: stands[m[0]], text) if odd and not text.isascii() else text
        if alike == text:
            return found.findall(text)
        return [text[m.start() : m.end()] for m in found.finditer(alike)]

    return split


def _ranges(chars) -> list[tuple[str, str]]:
    out: list[list[str]] = []
    for c in sorted(chars):
        if out and ord(c) == ord(out[-1][1]) + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return [(a, b) for a, b in out]


class Codec:
    """Encodes texts to packed ids and back. Pieces are remembered in a bounded memory."""

    def __init__(self, path: str, pattern: str = PATTERN, remembered: int = 400_000):
        self.v, self.split, self.remembered = Vocabulary.of(path), splitter(pattern), remembered
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def tokens(self, piece: bytes) -> list[int]:
        whole = self.v.ranks.get(piece)
        return [whole] if whole is not None else Prefixes(self.v, piece).ids()

    def piece(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            found = array("I", self.tokens(piece.encode())).tobytes()
        if len(piece) <= 64:
            if len(self.new) >= self.remembered:
                self.old, self.new = self.new, {}
            self.new[piece] = found
        return found

    def encode(self, text: str | None) -> bytes:
        pieces = self.split(text or "")
        packed = list(map(self.new.get, pieces))
        if None in packed:
            for k, p in enumerate(packed):
                if p is None:
                    packed[k] = self.new.get(pieces[k]) or self.piece(pieces[k])
        return b"".join(packed)

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.v.bytes_of.__getitem__, np.frombuffer(packed, DTYPE).tolist()))


class Editable:
    """A text under edits, with its ids; an edit encodes only what it can change.

    Every piece keeps the last tokens of its prefixes. An edit goes back to the first piece whose match
    looked at the edited place, keeps the prefixes of that piece before it, and stops where a new piece
    begins at a place where, moved by the edit, an old one began.
    """

    def __init__(self, path: str, pattern: str = PATTERN, text: str = ""):
        self.v, self.split = Vocabulary.of(path), splitter(pattern)
        self.text, self.starts, self.pieces, self.encoded = "", [], [], 0
        self.replace(0, 0, text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        """Puts new in the place of text[start:end]."""
        starts, size, shift = self.starts, len(self.text), len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        # the first piece whose match could see the place: it looks one character past its end
        first = bisect.bisect_left(starts, start + 1 - LOOKS)
        while first and (starts[first] if first < len(starts) else size) + 1 > start:
            first -= 1
        at = starts[first] if first < len(starts) else size
        old, old_start = (self.pieces[first], at) if first < len(self.pieces) else (None, 0)
        meets, made_starts, made, until = len(starts), [], [], max(start + len(new), at)
        for piece in self._from(at):
            if at >= until:
                k = bisect.bisect_left(starts, at - shift)
                if k < len(starts) and starts[k] == at - shift and at - shift >= end:
                    meets = k
                    break
            data = piece.encode()
            if old is not None and at == old_start:
                same = _shared(old.data, data)
                made.append(old.prefix(same))
            else:
                same = 0
                made.append(Prefixes(self.v))
            made[-1].append(data[same:])
            self.encoded += len(data) - same
            made_starts.append(at)
            at += len(piece)
        self.starts = starts[:first] + made_starts + [s + shift for s in starts[meets:]]
        self.pieces = self.pieces[:first] + made + self.pieces[meets:]

    def _from(self, at: int) -> Iterator[str]:
        """Pieces from a place on, split in stretches: the last one of a stretch may go on behind it."""
        size = 256
        while at < len(self.text):
            stretch = self.text[at : at + size]
            found, ends = self.split(stretch), at + size >= len(self.text)
            if not ends:
                # what looks past the stretch's end is not sure yet
                place, sure = 0, 0
                for piece in found:
                    if place + max(len(piece) + 1, LOOKS) > len(stretch):
                        break
                    place += len(piece)
                    sure += 1
                found = found[:sure]
            if not found:
                size *= 4
                continue
            for piece in found:
                yield piece
                at += len(piece)

    def ids(self) -> list[int]:
        return [t for p in self.pieces for t in p.ids()]


def _shared(a: bytes, b: bytes) -> int:
    """How many bytes two byte strings have in common from the start."""
    least = min(len(a), len(b))
    if a[:least] == b[:least]:
        return least
    return int((np.frombuffer(a[:least], np.uint8) != np.frombuffer(b[:least], np.uint8)).argmax())


def encode(docs: DataFrame, path: str, pattern: str = PATTERN) -> DataFrame:
    """doc_id and ids of each row of docs; null and empty texts have no ids.

    Of a long text a task holds the text, its pieces and its ids. Repeated rows are encoded each, null
    doc_ids stay, an empty table gives an empty result; other columns are not carried, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, pattern)
        for whole in batches:
            for batch in common.slices(whole, "text"):
                packed = [codec.encode(t) for t in batch.column("text").to_pylist()]
                sizes = np.cumsum([0, *[len(p) // 4 for p in packed]]).astype(np.int32)
                lists = pa.ListArray.from_arrays(sizes, pa.array(np.frombuffer(b"".join(packed), DTYPE).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "ids"])

    return common.spread(docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and bytes (`data`) of each row of (doc_id, ids); no ids or null give no bytes. Ids may end inside a character, so that bytes need not be a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = Vocabulary.of(path).bytes_of
        for batch in batches:
            data = [b"".join(bytes_of[i] for i in ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def encode_edited(docs: DataFrame, edits: DataFrame, path: str, pattern: str = PATTERN) -> DataFrame:
    """doc_id, ids and encoded_bytes of texts after an edit: `edits` has doc_id, start, length and new (text), at most one row a document.

    encoded_bytes counts the bytes that were encoded anew after the edit. Documents without an edit are
    not in the result; a start behind the end appends; nulls edit nothing. Of rows that share a doc_id
    each is edited.
    """
    names = ["doc_id", "start", "length", "new"]
    joined = docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "coalesce(text, '') AS text").join(edits.select(*names), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "text"):
                lists, counts = [], []
                for r in batch.to_pylist():
                    held = Editable(path, pattern, r["text"])
                    before, size = held.encoded, len(r["text"])
                    start = min(max(r["start"] or 0, 0), size)
                    held.replace(start, min(start + max(r["length"] or 0, 0), size), r["new"] or "")
                    lists.append(held.ids())
                    counts.append(held.encoded - before)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lists, pa.list_(pa.int32())), pa.array(counts, pa.int64())], ["doc_id", "ids", "encoded_bytes"])

    return joined.select("doc_id", "text", F.col("start").cast("int"), F.col("length").cast("int"), "new").mapInArrow(run, "doc_id long, ids array<int>, encoded_bytes long")


def round_trip(docs: DataFrame, path: str, pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids) and decoded_sha256 (of the bytes that the ids give).

    One row for each of docs, repeated or not; null texts count as empty. Long texts, empty tables and
    other columns as in encode().
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, pattern)
        for whole in batches:
            for batch in common.slices(whole, "text"):
                packed = [codec.encode(t) for t in batch.column("text").to_pylist()]
                columns = [batch.column("doc_id"), pa.array([len(p) // 4 for p in packed], pa.int64())]
                columns += [pa.array([hashlib.sha256(p).hexdigest() for p in packed]), pa.array([hashlib.sha256(codec.decode(p)).hexdigest() for p in packed])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return common.spread(docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
