"""SentencePiece encoding and decoding by a streaming Viterbi search.

The best segmentation is the one of largest total piece score. The search keeps scores for as many
boundaries as the longest piece has characters, and backpointers since the last commit. It commits
ids as soon as all surviving paths run through one boundary. Where no piece of a vocabulary goes on
over the start of a word, all paths run through each such start; what the stream commits between
two of them depends on that word alone and is kept in a bounded memory, so that a word is streamed
once. The model at hand has the scores of a BPE model: the best segmentation by its scores is not
always the one that its library's merges give.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

SPACE = "▁"
DTYPE = np.dtype("<u4")
RESULT = "doc_id long, ids array<int>"


class Vocabulary:
    """Pieces, scores and byte pieces of a SentencePiece model; one object for each process and model."""

    _loaded: dict[str, Vocabulary] = {}

    def __init__(self, model: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model)
        self.pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.bytes_of: list[bytes] = []
        self.byte_ids, self.ids, self.scores = {}, {}, {}
        for i, piece in enumerate(self.pieces):
            if m.is_byte(i):
                value = int(piece[3:-1], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            elif m.is_control(i) or m.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                self.ids[piece], self.scores[piece] = i, m.get_score(i)
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte pieces: texts could not be restored")
        self.longest = max(map(len, self.ids))
        self.worst = min(s for s in self.scores.values() if s > -1e8) - 10
        # every beginning of a piece, with the piece's score or None
        self.trie: dict[str, float | None] = {p[:k]: None for p in self.ids for k in range(1, len(p))} | self.scores
        # whether each start of a word is a sure boundary
        self.words_apart = not any(SPACE in p.lstrip(SPACE) for p in self.ids)

    @classmethod
    def of(cls, model: str) -> Vocabulary:
        if model not in cls._loaded:
            cls._loaded[model] = cls(model)
        return cls._loaded[model]

    def fallback(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode()]


class StreamingViterbi:
    """Feeds on text and gives lists of ids that can no longer change; between feeds only what lies behind the last committed boundary is held."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.text = ""  # from the last committed boundary on
        self.best: list[float | None] = [0.0]
        self.back: list[int] = [0]
        self.at = 0  # next position to expand
        self.reach = 0  # how far pieces go that begin before it

    def _path(self, text: str, back: list[int], start: int, end: int) -> list[int]:
        """Ids of the best path between two boundaries that all paths run through."""
        found, ids = self.v.ids, []
        while end > start:
            piece = text[back[end] : end]
            own = found.get(piece)
            if own is not None:
                ids.append(own)
            else:
                ids += self.v.fallback(piece)[::-1]
            end = back[end]
        ids.reverse()
        return ids

    def _run(self, more: str, last: bool) -> list[int]:
        text, score_of, worst, longest = self.text + more, self.v.trie.get, self.v.worst, self.v.longest
        end = len(text)
        best, back = self.best + [None] * (end + 1 - len(self.best)), self.back + [0] * (end + 1 - len(self.back))
        stop = end if last else end - longest + 1  # a piece might go on beyond what has been fed
        i, reach, start, ids, walk = self.at, self.reach, 0, [], self.at + 4 * longest
        while i < stop:
            if reach == i and i > start:  # every path runs through here
                ids += self._path(text, back, start, i)
                start, walk = i, i + 4 * longest
            here = best[i]
            if here is not None:
                j = i + 1
                score = score_of(text[i:j], 0)
                if not score:  # no piece of one character
                    spelt = here + worst * len(text[i].encode())
                    if best[j] is None or spelt > best[j]:
                        best[j], back[j] = spelt, i
                while score != 0:
                    if score is not None and (best[j] is None or here + score > best[j]):
                        best[j], back[j] = here + score, i
                    j += 1
                    if j > end:
                        break
                    score = score_of(text[i:j], 0)
                if j - 1 > reach:
                    reach = j - 1
                if reach <= i:
                    reach = i + 1
            i += 1
            if i >= walk:
                # do all surviving paths (ends within the reach of a piece) share a boundary?
                ends = {k for k in range(i, min(i + longest, end) + 1) if best[k] is not None}
                while len(ends) > 1 and max(ends) > start:
                    top = max(ends)
                    ends.discard(top)
                    ends.add(back[top])
                met = ends.pop() if ends else start
                if met > start:
                    ids += self._path(text, back, start, met)
                    start = met
                walk = i + 4 * longest
        if last:
            return ids + self._path(text, back, start, end)
        base = best[start]
        self.text, self.back = text[start:], [b - start for b in back[start:]]
        self.best = [None if s is None else s - base for s in best[start:]]
        self.at, self.reach = i - start, max(reach - start, 0)
        return ids

    def feed(self, text: str) -> Iterator[list[int]]:
        if ids := self._run(text, False):
            yield ids

    def finish(self) -> Iterator[list[int]]:
        if self.text and (ids := self._run("", True)):
            yield ids

    def whole(self, text: str) -> list[int]:
        """Ids of a text that is fed at once and ends."""
        return self._run(text, True)


class Codec:
    """Encodes texts to packed ids and back; decoding an encoded text gives exactly the text."""

    LONG = 2048

    def __init__(self, model: str, remembered: int = 250_000):
        self.v, self.remembered = Vocabulary.of(model), remembered
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def search(self, text: str) -> bytes:
        """Ids of a text in which spaces are marked already, from the stream, fed in parts."""
        stream, ids = StreamingViterbi(self.v), array("I")
        if len(text) <= self.LONG:
            return array("I", stream.whole(text)).tobytes()
        for k in range(0, len(text), self.LONG):
            for part in stream.feed(text[k : k + self.LONG]):
                ids.extend(part)
        for part in stream.finish():
            ids.extend(part)
        return ids.tobytes()

    def word(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.search(word)
        if len(word) <= 64:
            if len(self.new) >= self.remembered:
                self.old, self.new = self.new, {}
            self.new[word] = found
        return found

    def _marked(self, text: str, begins: bool) -> bytes:
        """Ids of a text without the mark itself; begins: with the mark that stands before every text."""
        words = text.split(" ")
        if not self.v.words_apart:
            return self.search((SPACE if begins else "") + SPACE.join(words))
        if "" in words:  # several spaces in a row are searched with the word behind them
            joined, marks = [], 0
            for k, w in enumerate(words):
                marks += bool(k or begins)
                if w or k == len(words) - 1:
                    joined.append(SPACE * marks + w)
                    marks = 0
            words = joined
        else:
            words = [SPACE + w for w in words] if begins else [words[0], *[SPACE + w for w in words[1:]]]
        new, out = self.new, []
        for w in words:
            packed = new.get(w)
            if packed is None:
                packed = self.word(w)
                new = self.new
            out.append(packed)
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if SPACE not in text:
            return self._marked(text, True)
        literal = np.array(self.v.fallback(SPACE), DTYPE).tobytes()
        head, *rest = text.split(SPACE)
        return self._marked(head, True) + b"".join(literal + (self._marked(t, False) if t else b"") for t in rest)

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, DTYPE).tolist()
        return b"".join(map(self.v.bytes_of.__getitem__, ids)).decode(errors="replace").removeprefix(" ")


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ids of each row of docs; null and empty texts have no ids.

    Of a long text a task holds the text and its ids, the search only a window. Repeated rows are
    encoded each, null doc_ids stay, an empty table gives an empty result; other columns are not
    carried, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for whole in batches:
            for batch in common.slices(whole, "text"):
                packed = [codec.encode(t) for t in batch.column("text").to_pylist()]
                sizes = np.cumsum([0, *[len(p) // 4 for p in packed]]).astype(np.int32)
                lists = pa.ListArray.from_arrays(sizes, pa.array(np.frombuffer(b"".join(packed), DTYPE).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "ids"])

    return common.spread(docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "text")).mapInArrow(run, RESULT)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of each row of (doc_id, ids); no ids or null give an empty text. Repeated rows are decoded each; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for batch in batches:
            texts = [codec.decode(np.array(ids or [], DTYPE).tobytes()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (unsigned, of little-endian 32-bit ids), decoded_bytes and restored (the decoded text equals the text; null as empty).

    One row for each of docs, repeated or not; long texts, empty tables and other columns as in encode().
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for whole in batches:
            for batch in common.slices(whole, "text"):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                packed = [codec.encode(t) for t in texts]
                back = [codec.decode(p) for p in packed]
                columns = [batch.column("doc_id"), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array([zlib.crc32(p) for p in packed], pa.int64())]
                columns += [pa.array([len(t.encode()) for t in back], pa.int64()), pa.array([a == b for a, b in zip(texts, back, strict=True)])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_ids", "ids_crc32", "decoded_bytes", "restored"])

    return common.spread(docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "text")).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decoded_bytes long, restored boolean")
