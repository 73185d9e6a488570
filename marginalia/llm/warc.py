"""WARC archives as seekable Zstandard bundles.

A bundle is a row of independent Zstandard frames, each with a group of whole WARC/1.1 records,
and at its end a skippable frame with the seek table (the public seekable format: 4-byte compressed
and decompressed sizes of each frame, then frame count, descriptor and magic number). The index
maps a record identifier to (bundle, frame, offset in the decompressed frame, length), so that a
single frame is read to fetch it. It is a Parquet table beside the bundles and also their manifest:
bundles of failed or repeated attempts are not in it and so never read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from . import common

# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
FOOTER = struct.Struct("<IBI")

CRLF = b"\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Folder of the index below that of the bundles.
INDEX = "index"
INDEX_SCHEMA = "record_id string, bundle string, frame int, offset long, length long"
RECORD_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean, bundle string, frame int, offset long"


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), types[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def record_uri(page_id: int | None, digest: str, ordinal: int = 0) -> str:
    """The identifier of a record: its page, its payload, and which of equal rows it is (the first without a number). It depends on no other row's place."""
    return f"urn:marginalia:page:{'' if page_id is None else page_id}:{digest}" + (f":{ordinal}" if ordinal else "")


def page_of(uri: str | None) -> int | None:
    page = uri.strip("<>").split(":")[3] if uri else ""
    return int(page) if page else None


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(record_id: str, url: str | None, payload: bytes, digest: str, revisit: bool, refers_to: int | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP head with the full length but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(4, "WARC-Target-URI: " + re.sub(r"[\r\n\0]", " ", url))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_uri(refers_to, digest)}>"]
    return "\r\n".join(head).encode() + CRLF * 2 + block + CRLF * 2


@dataclass
class Record:
    headers: dict[str, str]
    http: bytes
    payload: bytes
    offset: int
    length: int


def records_in(frame: bytes) -> Iterator[Record]:
    """The records of a decompressed frame."""
    at = 0
    while at < len(frame):
        end = frame.index(CRLF * 2, at)
        lines = frame[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no WARC record at {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        block = frame[end + 4 : end + 4 + int(headers["Content-Length"])]
        http, _, payload = block.partition(CRLF * 2)
        stop = end + 4 + len(block) + 4
        yield Record(headers, http, payload, at, stop - at)
        at = stop


class BundleWriter:
    """Writes records to one bundle; a frame closes once it has frame_bytes."""

    def __init__(self, sink, name: str, frame_bytes: int, level: int = 3):
        self.sink, self.name, self.frame_bytes = sink, name, frame_bytes
        self.codec, self.frames, self.index = zstandard.ZstdCompressor(level=level, write_checksum=True), [], []
        self.parts: list[bytes] = []
        self.open_bytes = self.written = 0

    def add(self, record_id: str, record: bytes) -> None:
        self.index.append((record_id, self.name, len(self.frames), self.open_bytes, len(record)))
        self.parts.append(record)
        self.open_bytes += len(record)
        if self.open_bytes >= self.frame_bytes:
            self.end_frame()

    def end_frame(self) -> None:
        if not self.parts:
            return
        packed = self.codec.compress(b"".join(self.parts))
        self.sink.write(packed)
        self.frames.append((len(packed), self.open_bytes))
        self.written += len(packed)
        self.parts, self.open_bytes = [], 0

    def close(self) -> None:
        self.end_frame()
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + FOOTER.pack(len(self.frames), 0, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.sink.close()


def seek_table(bundle) -> list[tuple[int, int, int]]:
    """(start, compressed size, decompressed size) of each frame, from the footer alone."""
    bundle.seek(-FOOTER.size, os.SEEK_END)
    n, _, magic = FOOTER.unpack(bundle.read(FOOTER.size))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    bundle.seek(-FOOTER.size - 8 * n, os.SEEK_END)
    start, found = 0, []
    for packed, size in struct.iter_unpack("<II", bundle.read(8 * n)):
        found.append((start, packed, size))
        start += packed
    return found


def read_frame(bundle, frame: int) -> bytes:
    start, packed, size = seek_table(bundle)[frame]
    bundle.seek(start)
    return zstandard.ZstdDecompressor().decompress(bundle.read(packed), max_output_size=max(size, 1))


def fetch(bundle, frame: int, offset: int, length: int) -> Record:
    """One record by its place in the index; reads the footer and one frame."""
    return next(records_in(read_frame(bundle, frame)[offset : offset + length]))


def files(where: str):
    """The file system (pyarrow) and the path of a folder that all executors share."""
    import pyarrow.fs as fs

    if "://" not in where and not where.startswith("file:"):
        return fs.LocalFileSystem(), where
    if where.startswith("file:"):
        return fs.LocalFileSystem(), "/" + where.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(where)


def write_archives(pages: DataFrame, where: str, *, least_bytes: int = 0, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 25) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) to bundles in a shared folder, and their index; returns the index.

    Among rows of equal payload (of at least least_bytes), that with the largest page_id is a
    response and the others revisit it; smaller payloads are all responses. A null html is an empty
    payload, a null page_id sorts before all others, a null url leaves its header out. Repeated rows
    of the largest page_id are all responses. A record's identifier names its page and its payload, so
    that rows that share a page_id have different ones and a revisit's target is known without a look-up;
    rows equal in both are numbered, and the first is the target. A long payload is held by one task with its
    frame. Bundles end at bundle_bytes; an attempt of a task writes files of its own, which count
    only once its part of the index is committed. An empty table writes no bundle. Other columns of
    pages are not kept, whatever their names.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.unhex(F.sha1(html)).alias("digest"))
    # narrow rows find the response of each payload; a payload that a third of the rows share is combined before the shuffle
    keys = rows.where(F.octet_length("html") >= least_bytes).select("page_id", "digest")
    newest = keys.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    older = keys.join(newest, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()
    older = older.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to")
    rows = rows.join(older, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    rows = rows.select("page_id", "url", "html", "digest", "refers_to", F.col("_digest").isNotNull().alias("revisit"))
    rows = _counted(rows).sortWithinPartitions("page_id", "revisit", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = files(where)
        store.create_dir(folder, recursive=True)
        attempt, writer, count = uuid.uuid4().hex, None, 0

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to", "revisit", "ordinal"))
            for page_id, url, text, digest, refers_to, revisit, ordinal in zip(*columns, strict=True):
                if writer is None:
                    name, count = f"{attempt}-{count:05d}.warc.zst", count + 1
                    writer = BundleWriter(store.open_output_stream(f"{folder}/{name}", compression=None), name, frame_bytes)
                told = base64.b32encode(digest).decode()
                record_id = record_uri(page_id, told, ordinal)
                writer.add(record_id, make_record(record_id, url, text.encode(), told, revisit, refers_to))
                if writer.written >= bundle_bytes:
                    writer.close()
                    yield batch_of(writer.index, INDEX_SCHEMA)
                    writer = None
        if writer is not None:
            writer.close()
            yield batch_of(writer.index, INDEX_SCHEMA)

    rows.mapInArrow(write, INDEX_SCHEMA).write.parquet(f"{where}/{INDEX}")
    return index_of(common.session_of(pages), where)


def _counted(rows: DataFrame) -> DataFrame:
    """Adds ordinal: from 0 among rows of equal page_id and digest. Only rows that have equals are dealt and numbered."""
    equal = F.struct("page_id", "digest")
    repeated = common.cut(rows.select("page_id", "digest").groupBy("page_id", "digest").count().where("count > 1").select(equal.alias("_equal")))
    if repeated.isEmpty():
        return rows.withColumn("ordinal", F.lit(0).cast("long"))
    several = rows.join(repeated, equal.eqNullSafe(F.col("_equal")), "left_semi").withColumn("_group", F.xxhash64("page_id", "digest")).withColumn("_tie", F.monotonically_increasing_id())
    several = common.numbered(several, "_group", ["_tie"], "ordinal").drop("_group", "_tie")
    return rows.join(repeated, equal.eqNullSafe(F.col("_equal")), "left_anti").withColumn("ordinal", F.lit(0).cast("long")).unionByName(several)


def index_of(spark, where: str) -> DataFrame:
    """The index of the bundles in a folder: record_id, bundle, frame, offset, length."""
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{where}/{INDEX}")


def fetch_records(index: DataFrame, where: str) -> DataFrame:
    """The records that the rows of an index point at, with their place; intact: the identifier and the payload's digest are as they should be.

    The rows of a bundle are sorted by their place; a task reads the footer of a bundle once and of
    each frame that is asked for its own bytes. A record asked for twice comes twice; an empty index
    gives none.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = files(where)
        codec, bundle, open_bundle, open_frame, frame, table = zstandard.ZstdDecompressor(), None, None, None, b"", []
        for batch in batches:
            rows = []
            for record_id, name, k, offset, length in zip(*(batch.column(c).to_pylist() for c in ("record_id", "bundle", "frame", "offset", "length")), strict=True):
                if name != open_bundle:
                    if bundle is not None:
                        bundle.close()
                    bundle, open_bundle, open_frame = store.open_input_file(f"{folder}/{name}"), name, None
                    table = seek_table(bundle)
                if k != open_frame:
                    start, packed, size = table[k]
                    bundle.seek(start)
                    frame, open_frame = codec.decompress(bundle.read(packed), max_output_size=max(size, 1)), k
                r = next(records_in(frame[offset : offset + length]))
                kind, digest = r.headers["WARC-Type"], r.headers["WARC-Payload-Digest"].removeprefix("sha1:")
                size = int(re.search(rb"Content-Length: (\d+)", r.http)[1])
                fits = kind == "revisit" and not r.payload or len(r.payload) == size and digest_of(r.payload) == digest
                fits = fits and r.headers["WARC-Record-ID"] == f"<{record_id}>"
                rows.append((page_of(r.headers["WARC-Record-ID"]), size, digest, kind, page_of(r.headers.get("WARC-Refers-To")), fits, name, k, offset))
            yield batch_of(rows, RECORD_SCHEMA)
        if bundle is not None:
            bundle.close()

    return index.repartition("bundle").sortWithinPartitions("bundle", "frame", "offset").mapInArrow(read, RECORD_SCHEMA)


def archive_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes pages to a fresh folder of archives and fetches every record back through the index."""
    where = common.fresh_dir(common.session_of(pages), "warc")
    return fetch_records(write_archives(pages, where, **options), where)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
d AS (SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
  (((CAST('0x' || substr(x || '0', 1 + (5 * i) // 4, 2) AS BIGINT)) >> CAST(3 - (5 * i) % 4 AS BIGINT)) & 31), 1)), '') AS payload_digest, max(page_id) OVER (PARTITION BY x) AS newest FROM p)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> newest THEN newest END AS refers_to, true AS intact FROM d
"""
