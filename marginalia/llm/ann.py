"""Approximate nearest neighbours: inverted file with product-quantised residuals.

Coarse centroids and codebooks are fitted on a bounded sample; every row is then assigned to its
nearest centroid and its residual is coded. A query probes its nearest cells until these hold a
given share of all rows: distances from asymmetric tables pick the rows that are reranked by exact
distance. Small cells share a shelf and large ones are cut into blocks, and the queries of a shelf
are dealt in chunks, so that a task compares a bounded block with a bounded chunk, a query's vector
goes to a shelf once, and a cell that holds a third of all rows is shared by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import common


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None], 0)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Centroids by Lloyd's rounds from distinct sample points; empty ones are put on the farthest points."""
    unique = np.unique(x, axis=0)
    k = min(k, len(unique))
    centres = unique[np.random.default_rng(seed).choice(len(unique), k, replace=False)]
    for _ in range(rounds):
        far = squared(x, centres)
        nearest, least = far.argmin(1), far.min(1)
        counts = np.bincount(nearest, minlength=k)
        sums = np.stack([np.bincount(nearest, x[:, d], k) for d in range(x.shape[1])], 1)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        if len(empty := np.flatnonzero(counts == 0)):
            centres[empty] = x[np.argsort(-least, kind="stable")[: len(empty)]]
    return centres


@dataclass
class Index:
    coarse: np.ndarray  # (cells, dims)
    books: list[np.ndarray]  # for each group of dimensions its codewords
    edges: list[int]

    @classmethod
    def fit(cls, sample: np.ndarray, cells: int, parts: int = 16, words: int = 256) -> Index:
        coarse = kmeans(sample, cells)
        rest = sample - coarse[squared(sample, coarse).argmin(1)]
        edges = np.linspace(0, sample.shape[1], min(parts, sample.shape[1]) + 1).astype(int).tolist()
        return cls(coarse, [kmeans(rest[:, a:b], words) for a, b in zip(edges, edges[1:], strict=False)], edges)

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = squared(x, self.coarse).argmin(1)
        rest = x - self.coarse[cell]
        return cell, np.stack([squared(rest[:, a:b], w).argmin(1) for a, b, w in zip(self.edges, self.edges[1:], self.books, strict=False)], 1).astype(np.uint8)

    def tables(self, queries: np.ndarray, cell: int) -> list[np.ndarray]:
        """For each part, squared distances of the queries' residuals in this cell to all codewords."""
        rest = queries - self.coarse[cell]
        return [squared(rest[:, a:b], w) for a, b, w in zip(self.edges, self.edges[1:], self.books, strict=False)]


def shelved(sizes: np.ndarray, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The shelf of each cell and the blocks of each shelf: cells in order share one until it has block_rows, a larger cell has one of its own."""
    shelf, blocks, held = np.zeros(len(sizes), np.int32), [], block_rows
    for cell, n in enumerate(sizes):
        if held + n > block_rows:
            blocks.append(max(1, -(-int(n) // block_rows)))
            held = 0
        held += n
        shelf[cell] = len(blocks) - 1
    return shelf, np.array(blocks, np.int64)


def search_block(index: Index, query_ids, queries, probed, row_ids, cells, codes, rows, k: int, rerank: int):
    """(query, row, exact distance) of the k nearest rows of a block for each query, among the cells that it probes (boolean, queries by cells); ties to the smaller id."""
    order = np.lexsort((row_ids, cells))
    row_ids, cells, codes, rows = row_ids[order], cells[order], codes[order], rows[order]
    starts = np.flatnonzero(np.diff(cells, prepend=-1))
    spans = list(zip(cells[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(cells)], strict=True))
    found = []
    for start in range(0, len(query_ids), 64):
        ids, some, own = query_ids[start : start + 64], queries[start : start + 64], probed[start : start + 64]
        near = np.full((len(ids), len(row_ids)), np.inf)
        for cell, first, last in spans:
            who = np.flatnonzero(own[:, cell])
            if len(who):
                part = np.zeros((len(who), last - first))
                for m, table in enumerate(index.tables(some[who], cell)):
                    part += table[:, codes[first:last, m]]
                near[who, first:last] = part
        near[ids[:, None] == row_ids[None]] = np.inf
        bound = np.partition(near, rerank - 1, axis=1)[:, rerank - 1] if rerank < len(row_ids) else np.full(len(ids), np.inf)
        for i, query in enumerate(ids):
            at = np.flatnonzero((near[i] <= bound[i]) & np.isfinite(near[i]))
            exact = np.sqrt(((rows[at] - some[i]) ** 2).sum(1))
            best = np.lexsort((row_ids[at], exact))[:k]
            found += zip([query] * len(best), row_ids[at[best]], exact[best], strict=True)
    return found


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array<double>) of the rows that take part: no null, no non-finite component, not all zero."""
    x = F.col("embedding").cast("array<double>")
    finite = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(finite & F.exists("x", lambda v: v != 0))


def nearest(vectors: DataFrame, k: int = 10, *, every: int = 100, sample_rows: int = 20_000, most_cells: int = 2048, probed: float = 0.75, rerank: int = 512, block_rows: int = 8192, chunk_queries: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows found for each row whose vec_id `every` divides.

    score is the Euclidean distance in double precision; ties go to the smaller vec_id. Candidates
    are all rows of another vec_id. Index: the root of the number of rows in cells (at most
    most_cells), fitted on at most sample_rows rows picked by a hash of vec_id; every row is indexed
    (of the width that most sampled rows have; distances to others are not defined). A query probes
    its nearest cells until these hold the share `probed` of all rows and k candidates, by the same
    rule at every size; of the rows of a block that it probes the `rerank` nearest by their codes,
    and all that tie with these, get exact distances. A repeated query id counts once (by its smallest vector); repeated candidates are
    candidates each. Rows that are not usable take no part. An empty table, or one without queries,
    gives an empty result. Vectors are held by block and by batch only, so long ones want smaller
    blocks; other columns are not carried, whatever their names.
    """
    spark = common.session_of(vectors)
    rows = usable(vectors)
    schema = "query_id long, rank int, vec_id long, score double"
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(sample_rows).select("x").toArrow().column("x").combine_chunks()
    if not len(sample):
        return spark.createDataFrame([], schema)
    widths = np.diff(sample.offsets.to_numpy())
    width = int(np.bincount(widths).argmax())
    rows = rows.where(F.size("x") == width)
    n = rows.count()
    flat, at = sample.values.to_numpy(), sample.offsets.to_numpy()[:-1][widths == width]
    index = Index.fit(flat[at[:, None] + np.arange(width)], min(most_cells, int(np.ceil(np.sqrt(n)))))
    matrix = lambda column: column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("x"))
            cell, codes = index.code(x)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([v.tobytes() for v in x], pa.binary())], ["vec_id", "cell", "code", "x"])

    indexed = common.cut(rows.mapInArrow(assign, "vec_id long, cell int, code binary, x binary"))
    sizes = np.zeros(len(index.coarse), np.int64)
    for r in indexed.groupBy("cell").count().collect():  # at most most_cells rows
        sizes[r["cell"]] = r["count"]
    shelf, blocks = shelved(sizes, block_rows)
    wanted = int(np.ceil(probed * n)) + k

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            x = matrix(b.column("x"))
            for query, own, v in zip(b.column("vec_id").to_pylist(), b.column("own").to_pylist(), x, strict=True):
                order = np.argsort(squared(v[None], index.coarse)[0], kind="stable").astype(np.int32)
                held = np.cumsum(sizes[order])
                cells = order[: int(np.searchsorted(held, min(n, wanted + own), "left")) + 1]
                for s in np.unique(shelf[cells]).tolist():
                    for column, value in zip(out, (query, s, cells[shelf[cells] == s].tobytes(), v.tobytes()), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["query_id", "shelf", "cells", "x"])

    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("x").alias("x"), F.count("*").alias("own"))
    queries = common.cut(asked.mapInArrow(probe, "query_id long, shelf int, cells binary, x binary"))
    # one row a shelf: how many blocks its rows and how many chunks its queries make
    chunks = queries.groupBy("shelf").agg(F.ceil(F.count("*") / chunk_queries).cast("int").alias("chunks")).collect()
    if not chunks:
        return spark.createDataFrame([], schema)
    shapes = F.broadcast(spark.createDataFrame([(r["shelf"], int(blocks[r["shelf"]]), r["chunks"]) for r in chunks], "shelf int, blocks int, chunks int"))
    shelves = F.broadcast(spark.createDataFrame([(c, int(s)) for c, s in enumerate(shelf)], "cell int, shelf int"))
    deal = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = indexed.join(shelves, "cell").join(shapes, "shelf").select("shelf", F.pmod(F.xxhash64("vec_id", "x"), "blocks").cast("int").alias("block"), deal("chunks").alias("chunk"), "vec_id", "cell", "code", "x")
    right = queries.join(shapes, "shelf").select("shelf", deal("blocks").alias("block"), F.pmod(F.xxhash64("query_id"), "chunks").cast("int").alias("chunk"), "query_id", "cells", "x")

    def search(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(rows) and len(asked):
            matrix = lambda column, kind: np.frombuffer(b"".join(column), kind).reshape(len(column), -1)
            probed = np.zeros((len(asked), len(index.coarse)), bool)
            for i, cells in enumerate(asked["cells"]):
                probed[i, np.frombuffer(cells, np.int32)] = True
            found = search_block(index, asked["query_id"].to_numpy(), matrix(asked["x"], np.float64), probed, rows["vec_id"].to_numpy(), rows["cell"].to_numpy(), matrix(rows["code"], np.uint8), matrix(rows["x"], np.float64), k, rerank)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    key = ["shelf", "block", "chunk"]
    hits = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
