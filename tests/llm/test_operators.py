"""The training-data operators against brute force, exact round trips and edge cases."""

from __future__ import annotations

import collections
import hashlib
import io
import itertools
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import public_tokenizers
from marginalia.llm import ann, langid, line_dedup, minhash, packing, sharding, spm, url_rules, warc, winnow

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "wort " * 30_000 + "\n" + "x" * 50_000
EDGE = [
    (1, "The quick brown fox jumps over the lazy dog today.\nAll rights reserved 2020.\nown line one here", "en", "a", 10),
    (2, "The quick brown fox jumps over the lazy dog today.\nAll rights reserved 2021.\nanother line two here", "en", "a", 10),
    (3, None, "en", "a", None),
    (4, "", None, None, 0),
    (5, " \n\t ", "de", "b", 3),
    (6, LONG, "de", "b", len(LONG)),
    (7, "Der schnelle Fuchs springt.", "de", "b", 1),
    (7, "Der schnelle Fuchs springt.", "de", "b", 1),  # a repeated row
    (None, "ohne Nummer", "de", None, 5),
    (8, "日本語 テキスト 😀\nzwei", None, "c", 9),
    (9, "a <|endoftext|> b <|endoftext|><|endoftext|>\n <|endoftext", "en", "c", 9),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS).withColumn("row", F.lit(1)).withColumn("leaf", F.lit("x")).withColumn("_group", F.lit(2)).withColumn("id", F.lit(3)).withColumn("kept", F.lit(False)).withColumn("key", F.lit(4))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


# 1: line dedup


def test_lines_same_as_sql(spark, docs):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    theirs = sorted(db.sql(f"SELECT doc_id, n_lines, n_dropped, text, emptied FROM ({line_dedup.SQL})").fetchall())
    ours = sorted(tuple(r) for r in line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "text", "emptied").collect())
    assert ours == theirs


def test_lines_edge_cases(edge, empty):
    got = {(r["doc_id"], r["text"]): r for r in line_dedup.dedup_lines(edge).collect()}
    assert (2, "another line two here") in got and got[2, "another line two here"]["n_dropped"] == 2  # the digits are a variable field
    assert got[3, None]["n_lines"] == 0 and got[6, LONG]["n_dropped"] == 0 and got[None, "ohne Nummer"]["n_dropped"] == 0
    assert got[1, EDGE[0][1]]["leaf"] == "x"
    assert line_dedup.dedup_lines(empty).count() == 0
    assert line_dedup.dedup_lines(edge, stats=False).columns == edge.columns


def test_lines_generalise_variable_fields(spark):
    names = ["ada", "bob", "eve", "kim"]
    rows = [(i, f"posted by {n} in the news of today with love\nbody {n} words differ here entirely {i}x") for i, n in enumerate(names)]
    rows.append((9, "posted by hand on quite other matters that share nothing else"))
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), depth=2).collect()}
    assert got[0] == 0 and got[9] == 0 and all(got[i] >= 1 for i in (1, 2, 3))


def test_short_lines_repeat_exactly(spark):
    rows = [(1, "Read more\n日本語2020年の行です\n2020\n\u3000\n\nown a"), (2, "Read  more\n日本語2020年の行です\n1999\n\u3000\n\nown b"), (3, "日本語2021年の行です\nRead more\n2020")]
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("1999\n\u3000\n\nown b", 2), 3: ("日本語2021年の行です", 2)}


def test_lines_of_many_templates_in_a_leaf(spark):
    kinds = [f"posted by someone {a} {b} {c} {d} {e} end" for a, b, c, d, e in (x.split() for x in ("in the news of today", "from a friend far away", "with love since early spring", "after much thought on things", "under old trees near water"))]
    rows = [(10 * k + i, kind.replace(" end", f" {name}")) for k, kind in enumerate(kinds) for i, name in enumerate(["ada", "bob", "eve"])]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for most_folded in (500, 3):  # in one step, and by rounds
        got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(table, most_folded=most_folded).collect()}
        assert got == {i: int(i % 10 > 0) for i, _ in rows}


def test_lines_when_nothing_is_broadcast(spark, docs, monkeypatch):
    before = sorted(tuple(r) for r in line_dedup.dedup_lines(docs).collect())
    monkeypatch.setattr(line_dedup, "MOST_BROADCAST", -1)
    assert sorted(tuple(r) for r in line_dedup.dedup_lines(docs).collect()) == before


def test_very_many_recurring_lines_in_a_text(spark):
    text = "\n".join(f"recurring line number {w} of this long list of lines" for w in ("a" * (1 + i % 7) + chr(97 + i % 26) + chr(97 + i // 26 % 26) + chr(97 + i // 676 % 26) for i in range(40_000)))
    table = spark.createDataFrame([(1, text), (2, text + "\nown")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_dropped"], r["text"] if r["doc_id"] == 2 else None) for r in line_dedup.dedup_lines(table).collect()}
    assert got == {1: (0, None), 2: (40_000, "own")}


# 2: near-duplicates


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def classes(rows):
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [(i, shingle_set(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def test_near_duplicates_brute_force(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = minhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == classes(rows)
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(shingle_set(t)) for i, t in rows}


def test_near_duplicates_of_a_family(spark):
    rng = np.random.default_rng(0)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(300):
        words = list(base)
        for k in rng.choice(60, rng.integers(0, 6), replace=False):
            words[k] = f"e{i}_{k}"
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows)


def test_near_duplicates_when_nothing_is_broadcast(docs):
    plain = sorted(tuple(r) for r in minhash.near_duplicates(docs).collect())
    assert sorted(tuple(r) for r in minhash.near_duplicates(docs, most_broadcast=-1, block=4).collect()) == plain


def test_near_duplicates_edge_cases(edge, empty):
    got = [r for r in minhash.near_duplicates(edge).collect()]
    assert len(got) == len(EDGE)
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert by[3][0]["n_shingles"] == 0 and by[5][0]["n_shingles"] == 0 and by[3][0]["component_id"] == 3
    assert [r["component_id"] for r in by[7]] == [7, 7]
    assert by[None][0]["component_id"] is None and by[None][0]["kept"]
    assert minhash.near_duplicates(empty).count() == 0


# 3: sharding


def test_differencing_is_tight():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 10_000, 3000).tolist()
    sums = np.bincount(sharding.differencing(sizes, 40), sizes, 40)
    assert sums.max() - sums.min() <= 20
    assert sharding.differencing([], 3) == [] and sharding.differencing([5, 4], 1) == [0, 0]


def test_differencing_against_all_partitions():
    """On few units the spread is within that of the best of all partitions, or a tenth of a part more."""
    rng = np.random.default_rng(8)
    for _ in range(20):
        sizes = rng.integers(1, 60, 8).tolist()
        best = min(max(s) - min(s) for s in ([sum(x for x, p in zip(sizes, parts, strict=True) if p == k) for k in range(3)] for parts in itertools.product(range(3), repeat=8)))
        sums = np.bincount(sharding.differencing(sizes, 3), sizes, 3)
        assert best <= sums.max() - sums.min() <= best + 0.1 * sum(sizes)


def test_shards(docs, edge, empty):
    rows = sharding.shard_by_bytes(docs, 7).collect()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == len(text)
    place = {}
    for r in rows:
        assert r["size"] == len(text[r["doc_id"]].encode()) + 16 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode())
        assert place.setdefault(text[r["doc_id"]], r["shard"]) == r["shard"]
    for k in range(7):
        own = sorted((r["slot"], r["doc_id"]) for r in rows if r["shard"] == k)
        assert [s for s, _ in own] == list(range(len(own))) and [d for _, d in own] == sorted(d for _, d in own)
    sums = np.bincount([r["shard"] for r in rows], [r["size"] for r in rows])
    assert sums.max() - sums.min() < 0.02 * sums.mean()
    got = sharding.shard_by_bytes(edge, 3).collect()
    assert len(got) == len(EDGE) and sum(r["size"] for r in got) == sum(len((t[1] or "").encode()) + 16 for t in EDGE)
    assert sharding.shard_by_bytes(empty, 3).count() == 0


# 4: SentencePiece

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def best_score(v, text):
    best = [0.0] + [-math.inf] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - v.longest), j):
            piece = text[i:j]
            score = v.scores.get(piece, v.worst * len(piece.encode()) if j == i + 1 else -math.inf)
            best[j] = max(best[j], best[i] + score)
    return best[-1]


def test_viterbi_is_the_best_and_streams():
    codec, rng = spm.Codec(MODEL), np.random.default_rng(2)
    letters = list("ab the ing  日é😀\n1=-#")
    texts = ["".join(rng.choice(letters, rng.integers(0, 90))) for _ in range(200)] + ["a" * 3000, "=-" * 2000, "thethe" * 500]
    for t in texts:
        packed = codec.encode(t)
        assert codec.decode(packed) == t
        if t:
            ids = np.frombuffer(packed, spm.DTYPE)
            got = sum(codec.v.scores.get(codec.v.pieces[i], codec.v.worst) for i in ids)
            assert abs(got - best_score(codec.v, "▁" + t.replace(" ", "▁"))) < 1e-3


def test_stream_commits_early_and_keeps_a_bounded_window():
    stream, most, committed = spm.StreamingViterbi(spm.Vocabulary.of(MODEL)), 0, 0
    for _ in range(200):
        for ids in stream.feed("thequickbrown" * 10):
            committed += len(ids)
        most = max(most, len(stream.text))
    assert committed and most < 2000


def test_sentencepiece_round_trip(edge, empty):
    rows = spm.round_trip(edge.unionByName(edge.sparkSession.createDataFrame([(20, "▁a ▁▁ b", "x", "x", 1)], DOCS), allowMissingColumns=True), MODEL).collect()
    assert len(rows) == len(EDGE) + 1 and all(r["restored"] for r in rows)
    back = spm.decode(spm.encode(edge, MODEL), MODEL).collect()
    assert sorted(r["text"] for r in back) == sorted(t[1] or "" for t in EDGE)
    assert spm.round_trip(empty, MODEL).count() == 0


# 5: WARC


def test_archives(spark, tmp_path):
    rows = [(1, "http://a/", "same"), (2, "http://b/\r\nX: 1", "same"), (3, None, None), (4, "u", ""), (5, "u", "größe" * 1000), (5, "u", "größe" * 1000), (None, "u", "same")]
    rows += [(10 + i, f"http://h/{i}", f"page {i % 7}" * 50) for i in range(100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("revisit", F.lit(2))
    got = warc.archive_round_trip(pages, frame_bytes=2000).collect()
    newest = {}
    for i, _, h in rows:
        newest[h or ""] = max(newest.get(h or "", -1), -1 if i is None else i)
    want = sorted((str(i), len((h or "").encode()), "response" if newest[h or ""] == i else "revisit", str(None if newest[h or ""] == i else newest[h or ""])) for i, _, h in rows)
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], str(r["refers_to"])) for r in got) == want
    assert all(r["intact"] and len(r["payload_digest"]) == 32 for r in got)
    where = str(tmp_path / "w")
    table = warc.write_archives(pages, where, frame_bytes=2000)
    index = table.collect()
    by = {r["record_id"]: r for r in index}
    assert len(by) == len(rows)  # identifiers are unique
    uri = lambda i: warc.record_uri(i, warc.digest_of(rows[[r[0] for r in rows].index(i)][2].encode()))
    some = warc.fetch_records(table.where(F.col("record_id").isin(*(uri(i) for i in (42, 77)))), where).collect()
    assert {r["page_id"] for r in some} == {42, 77} and all(r["intact"] for r in some)
    (tmp_path / "w" / "stale.warc.zst").write_bytes(b"left by a lost attempt")
    assert warc.fetch_records(warc.index_of(spark, where), where).count() == len(rows)
    r = by[uri(42)]
    with open(f"{where}/{r['bundle']}", "rb") as bundle:
        record = warc.fetch(bundle, r["frame"], r["offset"], r["length"])
    assert record.headers["WARC-Record-ID"] == f"<{uri(42)}>" and len(warc.seek_table(io.BytesIO(open(f"{where}/{r['bundle']}", "rb").read()))) > 1
    assert warc.archive_round_trip(pages.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "u", "lang " * 2_000_000), (2, "u", "kurz")], "page_id long, url string, html string")
    assert sorted((r["page_id"], r["payload_bytes"], r["intact"]) for r in warc.archive_round_trip(long).collect()) == [(1, 10_000_000, True), (2, 4, True)]


def test_every_revisit_leads_to_its_payload(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"page {i} of kind {k}" if k else "shared by all") for i in range(20) for k in range(3)]
    rows += [(5, "u", "A"), (5, "u", "B"), (3, "u", "B"), (None, "u", "B"), (7, "u", "A"), (7, "v", "A"), (7, "w", "A"), (2, "u", "A"), (2, "u", "A"), (None, None, None), (None, None, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    where = str(tmp_path / "w")
    index = warc.write_archives(pages, where, frame_bytes=300).collect()
    assert len({r["record_id"] for r in index}) == len(index) == len(rows)
    records = {}
    for r in index:
        with open(f"{where}/{r['bundle']}", "rb") as bundle:
            records[r["record_id"]] = warc.fetch(bundle, r["frame"], r["offset"], r["length"])
    revisits = [r for r in records.values() if r.headers["WARC-Type"] == "revisit"]
    assert len(revisits) == 19 + 2 + 3  # shared, B of 3 and none, A of 5 and twice of 2
    for r in revisits:
        target = records[r.headers["WARC-Refers-To"].strip("<>")]
        assert target.headers["WARC-Type"] == "response" and not r.payload and warc.digest_of(target.payload) == r.headers["WARC-Payload-Digest"].removeprefix("sha1:")
    payloads = collections.Counter(target.payload.decode() for target in (records[r.headers["WARC-Refers-To"].strip("<>")] if r.headers["WARC-Type"] == "revisit" else r for r in records.values()))
    assert payloads == collections.Counter(h or "" for _, _, h in rows)


# 6: fingerprints


def rolled(text, k):
    """Hashes of all runs of k code points, by a plain loop."""

    def chain(values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64(v.encode() if isinstance(v, str) else v.to_bytes(8, "little"), seed=seed).intdigest()
        return seed

    m, n = math.isqrt(k - 1) + 1, len(text)
    hashes = lambda part: [chain([c]) for c in part]
    short = lambda i: chain(hashes(text[i : i + m]))
    places = [*range(0, k - m, m), k - m]
    return [chain([short(i + p) for p in places if i + p < n]) & ((1 << 32) - 1) for i in range(max(1, n - k + 1))] if n else []


def winnowed(text, k=winnow.K, w=winnow.W):
    """(hash, position) of the smallest hash of each window, the rightmost on ties, by brute force."""
    hashes, found = rolled(text, k), []
    for a in range(max(1, len(hashes) - w + 1) if hashes else 0):
        window = hashes[a : a + w]
        at = a + max(i for i, h in enumerate(window) if h == min(window))
        if not found or found[-1][1] != at:
            found.append((hashes[at], at))
    return found


def like(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_winnowing_against_brute_force(spark, docs, monkeypatch):
    texts = [r["text"] for r in docs.orderBy(F.length("text")).limit(60).collect()]
    texts += [None, "", "a", "aa" * 40, "ab" * 40, "😀日本語" * 30, "x" * 15, "x" * 16, "y" * 31, "pq\n" * 4000, "".join(chr(97 + (i * i) % 23) for i in range(500))]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: winnowed(t or "") for i, t in enumerate(texts)}
    for stretch in (1 << 15, 37):
        monkeypatch.setattr(winnow, "STRETCH", stretch)
        got = {r["doc_id"]: [(x["hash"], x["position"]) for x in r["fingerprint"]] for r in winnow.fingerprints(table).collect()}
        assert got == want
        back = table.select(winnow.chosen(F.col("text")).alias("f"), winnow.unpacked(winnow.packed(winnow.chosen(F.col("text")), F.length("text"))).alias("g")).where("f IS NOT NULL").collect()
        assert all(r["f"] == r["g"] for r in back)
    odd = {r["doc_id"]: [(x["hash"], x["position"]) for x in r["fingerprint"]] for r in winnow.fingerprints(table.where("doc_id < 40"), 7, 5).collect()}
    assert odd == {i: winnowed(t or "", 7, 5) for i, t in enumerate(texts[:40])}


def test_shared_passages_leave_a_common_hash(spark):
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("abcdefghij日本"), n))
    rows = []
    for i in range(200):
        passage = word(winnow.K + winnow.W - 1)
        rows.append((i, word(rng.integers(0, 80)) + passage + word(rng.integers(0, 80)), word(rng.integers(0, 80)) + passage + word(rng.integers(0, 80))))
    both = spark.createDataFrame(rows, "i long, a string, b string").select(*[winnow.hashes_of(winnow.chosen(F.col(c))).alias(c) for c in "ab"])
    assert all(set(r["a"]) & set(r["b"]) for r in both.collect())


def test_comparison_against_brute_force(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy(F.length("text")).limit(120).collect()]
    base = sorted(rows, reverse=True)
    want = {}
    for (i, t), (_, other) in zip(base, base[1:] + base[:1], strict=True):
        edited = t[: len(t) - len(t) // 2] + other[: len(t) // 2]
        own, changed, following = winnowed(t), winnowed(edited), winnowed(other)
        show = lambda f: " ".join(f"{h:X}@{p}" for h, p in f)
        want[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), show(own), show(changed), like(own, changed), like(own, following))
    got = {r["doc_id"]: tuple(r)[1:] for r in winnow.compared(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_a_long_text(spark):
    text = "".join(np.random.default_rng(6).choice(list("abcdefgh "), 300_000))
    table = spark.createDataFrame([(1, text), (2, "x" + text), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: {x["hash"] for x in r["fingerprint"]} for r in winnow.fingerprints(table).collect()}
    assert len(got[1] & got[2]) >= 0.999 * len(got[1]) > 30_000 and got[3] == set()
    assert {r["doc_id"]: round(r["near_next"], 2) for r in winnow.compared(table).collect()} == {1: 0.0, 2: 1.0, 3: 0.0}


def test_edited_texts(spark, docs, edge, empty):
    for table, base in ((docs, [(r["doc_id"], r["text"]) for r in docs.collect()]), (edge.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), [t[:2] for t in EDGE if t[0] is not None])):
        base = sorted({(i, t or "") for i, t in base}, reverse=True)
        want = {}
        for (i, t), (_, other) in zip(base, base[1:] + base[:1], strict=True):
            want[i] = hashlib.sha256((t[: len(t) - len(t) // 2] + other[: len(t) // 2]).encode()).hexdigest()
        got = winnow.compared(table).collect()
        assert {r["doc_id"]: r["edited_sha256"] for r in got} == want
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert winnow.compared(edge).count() == len(EDGE) and winnow.compared(empty).count() == 0
    assert winnow.compared(edge.limit(1)).first()["near_next"] == 1.0  # a single row follows itself


def test_repeated_and_missing_ids(spark):
    rows = [(None, f"t{i} and more of this text to fill a window") for i in range(90)] + [(5, f"u{i} is what is written here at length") for i in range(80)] + [(7, "the same text again and again and again")] * 40 + [(None, None)] * 30 + [(i, f"{i} of many") for i in range(10, 60)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = winnow.compared(table).collect()
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), hashlib.sha1((r[1] or "").encode()).hexdigest()))
    want = collections.Counter()
    for (i, t), (_, other) in zip(order, order[1:] + order[:1], strict=True):
        t, other = t or "", other or ""
        want[i, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + other[: len(t) // 2]).encode()).hexdigest()] += 1
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want


def test_following_rows_in_buckets(spark):
    tie = lambda c: F.sha1(c.cast("string"))
    rows = spark.range(1000).select(F.col("id").alias("doc_id"), tie(F.col("id")).alias("_tie"), F.col("id").cast("string").alias("v"))
    got = {r["doc_id"]: r["next_v"] for r in winnow.followed(rows, ["v"], rows_per_bucket=37).collect()}
    assert got == {i: str((i - 1) % 1000) for i in range(1000)}
    # a third of the rows under one id, a third under none
    hot = spark.range(600).select(F.when(F.col("id") < 200, 50).when(F.col("id") >= 400, F.col("id") - 400).alias("doc_id"), tie(F.col("id")).alias("_tie"), F.col("id").cast("string").alias("v"))
    rows = sorted(((-(1 << 63) if r["doc_id"] is None else r["doc_id"], r["_tie"], r["v"]) for r in hot.collect()), key=lambda r: (-r[0], r[1]))
    got = {r["v"]: r["next_v"] for r in winnow.followed(hot, ["v"], rows_per_bucket=20).collect()}
    assert got == {a[2]: b[2] for a, b in zip(rows, rows[1:] + rows[:1], strict=True)}


def test_place_among_bounds(spark):
    import bisect

    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 5, 60):
        bounds = sorted(rng.choice(300, n, replace=False).tolist())
        got = spark.range(300).select("id", winnow.place_among(F.col("id"), bounds).alias("p")).collect()
        assert all(r["p"] == bisect.bisect_left(bounds, r["id"]) for r in got)


# 7: packing


def test_packing(docs, edge, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for table, rows in ((docs, [(r["doc_id"], r["text"]) for r in docs.collect()]), (edge, [r[:2] for r in EDGE])):
        want = collections.Counter((i, tuple(t.encode(x or "", add_special_tokens=False).ids) + (1,)) for i, x in rows)
        pieces = packing.pack(table, None, seq_len=256, with_ids=True).collect()
        sequences = collections.defaultdict(list)
        texts = collections.defaultdict(dict)
        for p in pieces:
            assert p["length"] == len(p["ids"]) > 0 and p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes())
            sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        for spans in sequences.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at == 256 or at & (at - 1) == 0
        by = collections.defaultdict(list)
        for p in pieces:
            by[p["doc_id"], p["doc_tokens"]].append((p["start"], tuple(p["ids"])))
        total = sum(len(i) * n for (_, i), n in want.items())
        assert sum(p["length"] for p in pieces) == total
        for (doc, ids), n in want.items():
            got = sorted(by[doc, len(ids)])
            assert n > 1 or tuple(x for _, part in got for x in part) == ids
    assert packing.pack(empty, None).count() == 0


def test_packing_order_and_parts(spark, docs, edge):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    signs = packing.projection(50257, 3)

    def key(text):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        cell = np.minimum(((np.tanh(4 * signs[:, ids].astype(float).sum(1) / len(ids)) + 1) * (1 << 15)).astype(np.int64), (1 << 16) - 1)
        return int(packing.hilbert(cell[:, None], 16)[0])

    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    hot = [(None, "the same text")] * 300  # equal rows in several parts
    table = spark.createDataFrame(rows + hot, "doc_id long, text string")
    got = packing.pack(table, seq_len=128, tokens_per_part=1000).collect()
    sequences = sorted(got, key=lambda p: (p["sequence_id"], p["offset"]))
    keys = dict(rows)
    order = [key("the same text" if p["doc_id"] is None else keys[p["doc_id"]]) for p in sequences]
    assert order == sorted(order)  # neighbours on the curve share sequences
    parts = collections.Counter()
    for p in sequences:
        parts[p["sequence_id"] >> 36] += p["length"]
    longest = max(p["doc_tokens"] for p in got)
    assert len(parts) > 20 and max(parts.values()) <= 1000 + longest
    assert max(sum(p["doc_id"] is None for p in sequences if p["sequence_id"] >> 36 == k) for k in parts) < 300


def test_hilbert_curve_is_continuous():
    points = np.stack([x.ravel() for x in np.meshgrid(*[np.arange(8)] * 3, indexing="ij")])
    key = packing.hilbert(points, 3)
    assert sorted(key) == list(range(512))
    walk = points[:, np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=1)).sum(0) == 1).all()


# 8: URLs


def test_url_rules(spark):
    urls = ["http://Example.ORG/es/x", "https://a.b.example.org/en/123?q#f", "http://example.com/fr/1", "http://x.com/de/2", "http://com", "//no", None, "", "http://notexample.org/es/", "ftp://user@h.net?x", "http://example.org", "http://a/://b.com/fr/"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("tokens", F.lit(1)).withColumn("rule", F.lit("x"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: tuple(r)[1:5] for r in url_rules.judge(rows, labels).select("page_id", "host", "path", "rule", "verdict").collect()}
    assert got[0] == ("example.org", "/es/x", "example.org/es/", "block")
    assert got[1] == ("a.b.example.org", "/en/123", "example.org/en/1", "block")
    assert got[2][2:] == ("com/fr/", "allow") and got[3][2:] == ("com/de/", "block")
    assert got[4] == ("com", "", None, "allow")  # an empty path does not start with /
    assert got[5][:2] == ("", "") and got[6][:2] == ("", "") and got[7][:2] == ("", "")
    assert got[8][2:] == ("org/", "allow") and got[9][:2] == ("user@h.net", "") and got[10][2] is None
    assert url_rules.judge(rows.limit(0), labels).count() == 0


def test_mined_rules_fire(spark):
    rows = [(i, f"http://{'casino-win' if i % 4 == 0 else 'news'}{i % 3}.site.net/{'play' if i % 4 == 0 else 'read'}/{i}") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, 1 if i % 4 == 0 else 0) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge(pages, labels).collect()}
    assert all(got[i] == ("block" if i % 4 == 0 else "allow") for i in range(400))


def test_mined_rule_of_four_tokens(spark):
    words = ["win", "play", "cash", "now"]
    urls = ["/".join(words)] * 40 + ["/".join(w for w in words if w != left) for left in words for _ in range(40)]
    pages = spark.createDataFrame([(i, f"http://site.net/{u}/{i}") for i, u in enumerate([*urls, "/".join(words)])], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, int(i < 40)) for i in range(len(urls))], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge(pages, labels).collect()}
    assert got == {i: "block" if i < 40 or i == len(urls) else "allow" for i in range(len(urls) + 1)}


def test_a_token_of_nearly_all_rows_can_be_in_a_rule(spark):
    # bad are pages with x that also have the token of 95 % of the rows
    rows = [(i, ["host=com", "path=common", f"path=p{i % 7}"] + (["path=x"] if i % 4 == 0 else [])) for i in range(380)] + [(1000 + i, ["host=com", "path=x"]) for i in range(20)]
    tokens = spark.createDataFrame(rows, "page_id long, tokens array<string>")
    labels = spark.createDataFrame([(i, "path=x" in t and "path=common" in t) for i, t in rows], "doc_id long, bad boolean")
    got = {tuple(r["antecedent"]): r["confidence"] for r in url_rules.mine(tokens, labels).collect()}
    assert got[("path=common", "path=x")] == 1.0 and 0.8 < got[("path=x",)] < 1.0 and not any("host=com" in a for a in got)


def test_mining_against_all_combinations(spark):
    """Every combination of tokens counted one by one: support, confidence, lift, then the pruning of longer rules."""
    rng = np.random.default_rng(9)
    words = ["win", "play", "cash", "now", "read", "news"]
    rows = [sorted(rng.choice(words, rng.integers(1, 5), replace=False).tolist()) for _ in range(300)]
    bad = [bool({"win", "cash"} <= set(t) and rng.random() < 0.9 or rng.random() < 0.1) for t in rows]
    want, share = {}, sum(bad) / len(bad)
    for size in range(1, 6):
        for tokens in itertools.combinations(words, size):
            holds = [b for t, b in zip(rows, bad, strict=True) if set(tokens) <= set(t)]
            if sum(holds) >= 8 and sum(holds) / len(holds) >= 0.6 and sum(holds) / len(holds) / share >= 1.5:
                want[tuple(sorted(tokens))] = sum(holds) / len(holds)
    want = {t: c for t, c in want.items() if not any(set(u) < set(t) and d >= c for u, d in want.items())}
    tokens = spark.createDataFrame(list(enumerate(rows)), "page_id long, tokens array<string>")
    labels = spark.createDataFrame(list(enumerate(bad)), "doc_id long, bad boolean")
    got = {tuple(r["antecedent"]): r["confidence"] for r in url_rules.mine(tokens, labels).collect()}
    assert want and set(got) == set(want) and all(abs(got[t] - c) < 1e-9 for t, c in want.items())
    # the index finds exactly the rows that have all tokens of a rule, broadcast or not
    sets = tokens.select(F.col("page_id").alias("_set"), "tokens")
    for most in (20_000, -1):
        hits = {r["_set"]: r["confidence"] for r in url_rules.fired(sets, url_rules.mine(tokens, labels), most_rules=most).collect()}
        assert hits == {i: max(c for u, c in want.items() if set(u) <= set(t)) for i, t in enumerate(rows) if any(set(u) <= set(t) for u in want)}


def test_long_urls(spark):
    long = "http://a.example.com/" + "/".join(f"part{i}" for i in range(20_000))
    got = url_rules.judge(spark.createDataFrame([(1, long), (1, long), (None, None)], "page_id long, url string"), spark.createDataFrame([], "doc_id long, quality int, toxic int"), most_sets=-1).collect()
    assert sorted((str(r["page_id"]), len(r["path"]), r["verdict"]) for r in got) == [("1", len(long) - 20, "allow"), ("1", len(long) - 20, "allow"), ("None", 0, "allow")]


# 9: language


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    shown = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    got = langid.identify(shown).join(docs.where("doc_id % 2 = 1").select("doc_id", F.col("lang").alias("truth")), "doc_id")
    r = got.agg(F.avg((F.col("detected") == F.col("truth")).cast("int")).alias("right"), F.avg(F.col("kept").cast("int")).alias("kept")).first()
    assert r["right"] > 0.97 and r["kept"] > 0.98


def test_language_edge_cases(spark, edge, empty):
    train = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("doc_id", F.col("doc_id") + 1000)
    got = collections.defaultdict(list)
    for r in langid.identify(train.unionByName(edge.select(*train.columns))).where("doc_id IS NULL OR doc_id < 1000").collect():
        got[r["doc_id"]].append(r)
    assert sum(map(len, got.values())) == len(EDGE)
    assert all(got[i][0]["detected"] == "und" and not got[i][0]["kept"] for i in (3, 4, 5))
    assert got[7][0]["detected"] == "de" and got[7][0] == got[7][1]
    assert langid.identify(empty).count() == 0
    assert {r["detected"] for r in langid.identify(edge.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_rare_languages_are_trained(spark):
    rng = np.random.default_rng(7)
    words = {k: ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(20)] for k in range(70)}
    text = lambda k: " ".join(rng.choice(words[k], 60))
    rows = [(f"l{k:02}", text(k)) for k in range(70) for _ in range(6)] + [("l00", text(0)) for _ in range(3000)]
    rows = [(i, t, x, "s") for i, (x, t) in enumerate(rows)] + [(10_000 + k, text(k), None, "s") for k in range(70)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), sample_rows=50).where("doc_id >= 10000").collect()
    assert [(r["doc_id"], r["detected"]) for r in got if r["detected"] != f"l{r['doc_id'] - 10_000:02}" or not r["kept"]] == []


def test_language_without_a_broadcast(spark, docs):
    plain = sorted(tuple(r) for r in langid.identify(docs).collect())
    assert sorted(tuple(r) for r in langid.identify(docs, most_hosts=-1).collect()) == plain


def test_page_evidence(spark):
    html = "<!DOCTYPE html><HTML class='a' lang='de-AT'><style>p{}</style><script>var t='</p>';</script><body><!-- no --><p>Gr&uuml;&szlig;e <b>an</b> alle</p>"
    rows = [(1, "https://me@News.Example.AT:80/a?b", html), (2, None, None), (3, "no address", "plain")]
    got = [tuple(r) for r in langid.page_rows(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("doc_id").collect()]
    assert got == [(1, "Grüße an alle", "de", "news.example.at", "at"), (2, None, "", "", ""), (3, "plain", "", "", "")]


def test_language_of_pages(spark):
    from marginalia.llm import queries

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in queries.op9_language_pages(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == pages.count() and {r["declared_as"] for r in got.values()} == {"en", "de", "fr", "es"}
    assert sum(r["detected"] == r["declared_as"] for r in got.values()) > 0.9 * len(got)


def test_language_prior_of_a_suffix(spark):
    train = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang IN ('en', 'de')")
    rows = train.select((F.col("doc_id") + 10).alias("doc_id"), "text", "lang", F.concat("lang", F.lit("-"), (F.col("doc_id") % 50).cast("string")).alias("host"), F.when(F.col("lang") == "de", "de").otherwise("com").alias("suffix"))
    # a text that says nothing, at hosts nobody knows: only the suffix tells
    odd = spark.createDataFrame([(1, "xq", None, "new1", "de"), (2, "xq", None, "new2", "com")], rows.schema)
    got = {r["doc_id"]: r for r in langid.identify(rows.unionByName(odd), declared="lang", host="host", suffix="suffix").where("doc_id < 10").collect()}
    assert (got[1]["detected"], got[2]["detected"]) == ("de", "en")
    flat = {r["doc_id"]: r for r in langid.identify(rows.unionByName(odd), declared="lang", host="host").where("doc_id < 10").collect()}
    assert flat[1]["detected"] == flat[2]["detected"]


# 10: nearest neighbours


def test_nearest_recall_and_order(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 1, (1500, 16)) for c in (0, 3, -3)])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(rows, 10, every=100, block_rows=300, chunk_queries=16, rerank=128).collect()
    hits = 0
    for q in range(0, len(x), 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r[0] for r in own] == list(range(1, 11)) and all(abs(s - d[v]) < 1e-9 for _, v, s in own)
        hits += len({v for _, v, _ in own} & set(np.argsort(d)[:10].tolist()))
    assert hits >= 0.9 * len({r["query_id"] for r in got}) * 10


@pytest.mark.parametrize("block_rows", [8192, 200])
def test_nearest_recall_on_the_table(spark, block_rows):
    """At the parameters of the query: 45 cells, of which some are never probed; then also in small blocks."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = ann.nearest(rows, block_rows=block_rows).collect()
    ids, x = zip(*((r["vec_id"], r["embedding"]) for r in rows.collect()), strict=True)
    ids, x = np.array(ids), np.array(x, np.float64)
    own = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        own[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    assert set(own) == {i for i in ids.tolist() if i % 100 == 0}
    for q, found in own.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        assert len(found) == 10 and all(abs(s - d[ids == v][0]) < 1e-12 for v, s in found) and found == sorted(found, key=lambda p: (p[1], p[0]))
        hits += len({v for v, _ in found} & set(ids[np.argsort(d)[:10]].tolist()))
    assert hits >= 0.9 * 10 * len(own), hits / (10 * len(own))


@pytest.mark.parametrize("n", [1, 5, 11, 12, 40])
def test_nearest_of_few_rows(spark, n):
    rows = spark.createDataFrame([(100 * i, [float(i), 1.0, float(i % 3)]) for i in range(n)], "vec_id long, embedding array<double>")
    got = collections.Counter(r["query_id"] for r in ann.nearest(rows, 10).collect())
    assert got == ({100 * i: min(10, n - 1) for i in range(n)} if n > 1 else {})


def test_nearest_edge_cases(spark):
    rows = [(0, [1.0, 0.0]), (5, [2.0, 0.0]), (3, [2.0, 0.0]), (4, None), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [None, 1.0]), (9, [float("inf"), 1.0]), (None, [1.0, 1.0]), (100, [1.5, 0.0]), (0, [1.0, 0.0]), (11, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit(1)).withColumn("x", F.lit(2))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.nearest(table, 10).collect()}
    assert got[0, 1] == (100, 0.5) and got[0, 2] == (3, 1.0) and got[0, 3] == (5, 1.0) and (0, 4) not in got
    assert [got[100, k] for k in (1, 2, 3, 4)] == [(0, 0.5), (0, 0.5), (3, 0.5), (5, 0.5)]
    assert ann.nearest(table.limit(0)).count() == 0
