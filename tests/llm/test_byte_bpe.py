"""Byte-level BPE against the library whose ids it has to give, texts under edits, and edge cases."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from marginalia.llm import bpe, queries

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
DOCS = "doc_id long, text string, ids string, data int, new string"


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(PATH)


@pytest.fixture(scope="module")
def pool(codec):
    some = random.Random(3).sample(sorted(codec.v.ranks), 2000)
    return [t.decode(errors="ignore") for t in some] + list("aaaabb  \n\t\r'streve1234!?.,-é日本語😀́​\u0085　\x1c\U000323ef\U00011de5࢏")


def digests(ids):
    return hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_every_character_is_split_as_in_the_library(codec, library):
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(chars), 20_000):
        text = "".join(f"a{c}1{c} {c}" for c in chars[k : k + 20_000])
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_random_texts_have_the_ids_of_the_library(codec, library, pool):
    rng = random.Random(1)
    for k in range(3000):
        text = rng.choice("ab '1") * rng.randint(1, 300) if k % 10 == 0 else "".join(rng.choice(pool) for _ in range(rng.randint(0, 30)))
        packed = codec.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text), repr(text)
        assert codec.decode(packed) == text.encode()


def test_every_prefix_has_its_own_encoding(codec, library):
    piece = "Donaudampfschifffahrtsgesellschaftskapitän日本語".encode()
    held = bpe.Prefixes(codec.v, piece)
    for size in range(len(piece) + 1):
        assert held.ids(size) == (library._encode_single_piece(piece[:size]) if size else [])


def test_a_small_memory_changes_nothing(codec, library):
    small = bpe.Codec(PATH, remembered=3)
    text = " ".join(f"word{i % 11} and other{i % 5}" for i in range(400))
    assert small.encode(text) == codec.encode(text) and len(small.new) <= 3


def test_a_token_that_no_merge_makes_is_found_as_a_whole_piece_only(tmp_path):
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 300, b"xyzw": 301, b"bcd": 302}
    path = tmp_path / "odd.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
    theirs, ours = tiktoken.Encoding("odd", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.Codec(str(path), PATTERN)
    for text in ("xyzw", "axyzw", "abcd", "abc", "bcd", "xyzw abcabcd"):
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == theirs.encode_ordinary(text), text


def test_edits_equal_encoding_the_whole(library, pool):
    rng = random.Random(2)
    for k in range(400):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 400 if k % 20 == 0 else 20)))
        held = bpe.Editable(PATH, text=text)
        for _ in range(4):
            a = rng.randint(0, len(text))
            b, new = min(len(text), a + rng.choice([0, 0, 1, 2, 5, 50])), "".join(rng.choice(pool) for _ in range(rng.randint(0, 4)))
            if a == len(text):
                held.append(new)
            else:
                held.replace(a, b, new)
            text = text[:a] + new + text[b:]
            assert held.text == text and held.ids() == library.encode_ordinary(text), (text, a, b, new)


def test_edits_encode_near_the_place_only():
    held = bpe.Editable(PATH, PATTERN, "wort " * 30_000)
    before = held.encoded
    held.replace(75_000, 75_001, "x")
    assert held.encoded - before < 20
    held = bpe.Editable(PATH, PATTERN, "x" * 20_000)
    before = held.encoded
    held.append("yz")
    assert held.encoded - before == 2  # the prefixes of the long piece stay


EDGE = [(1, "It's a test　 of 日本語 2024!"), (2, None), (3, ""), (4, " \n\t "), (5, "x" * 60_000 + " " + "wort " * 20_000), (6, "same"), (6, "same"), (None, "no number"), (7, "a\x00b <|endoftext|> ")]


def test_query_columns_and_edge_rows(spark, library):
    rows = [(i, t, "x", 1, "y") for i, t in EDGE]
    got = bpe.round_trip(spark.createDataFrame(rows, DOCS), PATH, PATTERN)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = [(i, len(ids := library.encode_ordinary(t or "")), digests(ids), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in EDGE]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert bpe.round_trip(spark.createDataFrame([], DOCS), PATH, PATTERN).count() == 0
    assert bpe.encode(spark.createDataFrame([], DOCS), PATH, PATTERN).count() == 0


def test_query_on_the_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r["doc_id"]: tuple(r) for r in queries.op11_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode_ordinary(r["text"] or "")
        assert got[r["doc_id"]] == (r["doc_id"], len(ids), digests(ids), hashlib.sha256((r["text"] or "").encode()).hexdigest())


def test_frames_encode_decode_and_edit(spark, library):
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in EDGE], DOCS)
    encoded = bpe.encode(docs, PATH, PATTERN)
    back = sorted((str(r["doc_id"]), bytes(r["data"])) for r in bpe.decode(encoded, PATH).collect())
    assert back == sorted((str(i), (t or "").encode()) for i, t in EDGE)
    edits = spark.createDataFrame([(1, 5, 1, "the"), (2, 0, 0, "new"), (3, 9, 9, "end"), (5, 60_000, 0, "y"), (6, None, None, None), (99, 0, 0, "no")], "doc_id long, start int, length int, new string")
    got = bpe.encode_edited(docs, edits, PATH, PATTERN).collect()
    texts = {1: "It's the test　 of 日本語 2024!", 2: "new", 3: "end", 5: "x" * 60_000 + "y " + "wort " * 20_000, 6: "same"}
    assert sorted(r["doc_id"] for r in got) == [1, 2, 3, 5, 6, 6]
    assert all(list(r["ids"]) == library.encode_ordinary(texts[r["doc_id"]]) for r in got)
    assert all(r["encoded_bytes"] < 20 for r in got)
