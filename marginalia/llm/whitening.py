"""Whitening of embeddings with exact integer moments.

Entries become integers. Sums and products of integers are gathered without rounding: matrices of
integers are split into digits so small that float64 products of the digit matrices are exact, BLAS
multiplies those, and the digits of the results are put together as big integers. Tasks' results are
added up as integers too, so that the covariance is the same for every split of the rows, and only the
eigendecomposition of one matrix as wide as a vector rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import common

SCALE, OFFSET = 64, 1_000_000
#: Rows of one exact product, and bits of a digit: a sum of ROWS products of two digits stays below 2 ** 53.
ROWS, BITS = 1 << 13, 20
#: Floats below this become 64-bit integers after scaling, with room for a difference of two.
NARROW = float(1 << 55)
#: Partial covariances of tasks are merged in so many streams before the driver sees them.
STREAMS = 64
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integers(entries: np.ndarray) -> np.ndarray:
    """floor(64 * c) + 1000000 of float64 entries, as 64-bit integers, or as Python's where they would not fit."""
    if not entries.size or np.abs(entries).max() < NARROW:
        return np.floor(SCALE * entries).astype(np.int64) + OFFSET
    whole = [SCALE * int(c) if abs(c) >= NARROW else int(np.floor(SCALE * c)) for c in entries.ravel().tolist()]
    return (np.array(whole, dtype=object) + OFFSET).reshape(entries.shape)


def centred(x: np.ndarray, middle: list[int]) -> np.ndarray:
    """x minus a whole number for each dimension, exact."""
    if x.dtype == np.int64 and all(abs(m) < 1 << 62 for m in middle):
        return x - np.array(middle, np.int64)
    return x.astype(object) - np.array(middle, dtype=object)


def digits(a: np.ndarray) -> list[np.ndarray]:
    """Signed digits of BITS bits, lowest first, as float64 matrices."""
    below = a < 0
    rest, sign, out = np.where(below, -a, a), np.where(below, -1.0, 1.0), []
    while (rest != 0).any():
        out.append(sign * (rest & ((1 << BITS) - 1)).astype(np.float64))
        rest = rest >> BITS
    return out


class ExactSum:
    """A growing sum of exact products of integer matrices."""

    def __init__(self, rows: int, columns: int):
        self.total = np.zeros((rows, columns), dtype=object)
        self.by_place: dict[int, np.ndarray] = {}
        self.added = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Adds a.T @ b."""
        for at in range(0, len(a), ROWS):
            left = digits(a[at : at + ROWS])
            right = left if b is a else digits(b[at : at + ROWS])
            for i, p in enumerate(left):
                for j, q in enumerate(right):
                    product = (p.T @ q).astype(np.int64)
                    held = self.by_place.get(i + j)
                    self.by_place[i + j] = product if held is None else held + product
            self.added += len(left)
            if self.added >= 256:  # places hold less than 2 ** 53 a product: far from their end still
                self._carry()

    def _carry(self) -> None:
        for place, held in self.by_place.items():
            self.total = self.total + (held.astype(object) << (BITS * place))
        self.by_place, self.added = {}, 0

    def value(self) -> np.ndarray:
        self._carry()
        return self.total


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of integer matrices of any size of entries."""
    out = ExactSum(len(a), b.shape[1])
    out.add(np.ascontiguousarray(a.T), b)
    return out.value()


def ratio(a: np.ndarray, by: int) -> np.ndarray:
    """Big integers divided by one, each rounded once to float64."""
    return np.array([int(v) / by for v in a.ravel()], np.float64).reshape(a.shape)


def rank(a: np.ndarray) -> int:
    """The rank of an integer matrix, by elimination modulo two primes (below the rank only if both divide its minors)."""
    found = 0
    for p in (2_147_483_647, 2_147_483_629):
        m = np.array([[int(v) % p for v in row] for row in a], np.int64).reshape(a.shape)
        at = 0
        for c in range(m.shape[1]):
            rows = np.nonzero(m[at:, c])[0]
            if not len(rows):
                continue
            m[[at, at + rows[0]]] = m[[at + rows[0], at]]
            m[at] = m[at] * pow(int(m[at, c]), -1, p) % p
            m[at + 1 :] = (m[at + 1 :] - m[at + 1 :, c : c + 1] * m[at] % p) % p
            at += 1
        found = max(found, at)
    return found


def jacobi(a: np.ndarray, sweeps: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of a symmetric matrix with small entries right in relation to their size, by plane rotations."""
    a, q = a.copy(), np.eye(len(a))
    for _ in range(sweeps):
        size = np.sqrt(np.abs(np.diag(a)))
        far = np.argwhere(np.triu(np.abs(a) > 1e-15 * np.outer(size, size), 1))
        if not len(far):
            break
        for i, j in far:
            if a[i, j] == 0:
                continue
            t = (a[j, j] - a[i, i]) / (2 * a[i, j])
            t = (1.0 if t >= 0 else -1.0) / (abs(t) + np.hypot(1.0, t))
            c = 1 / np.hypot(1.0, t)
            turn = np.array([[c, t * c], [-t * c, c]])
            a[:, [i, j]] = a[:, [i, j]] @ turn
            a[[i, j]] = turn.T @ a[[i, j]]
            a[i, j] = a[j, i] = 0.0
            q[:, [i, j]] = q[:, [i, j]] @ turn
    return np.diag(a).copy(), q


def components(scatter: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues (falling, above zero) and unit eigenvectors (as columns) of scatter / n ** 2.

    The vectors of the float64 decomposition are set against the exact matrix once more: in their basis
    it is nearly diagonal, and that is made diagonal with errors in relation to each eigenvalue, not to the largest.
    """
    held = min(most, rank(scatter))
    _, q = np.linalg.eigh(ratio(scatter, n * n))
    fine = 1 << 60
    whole = np.array([int(v) for v in np.rint(q * 2.0**53).ravel()], dtype=object).reshape(q.shape) << 7
    turned = ratio(exact_product(exact_product(whole.T, scatter), whole), n * n * fine * fine)
    values, turn = jacobi((turned + turned.T) / 2)
    order = np.argsort(-values, kind="stable")[:held]
    vectors = q @ turn[:, order]
    return values[order], vectors / np.linalg.norm(vectors, axis=0)


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """vec_id and the integers of runs of rows, at most ROWS and about a million entries each."""
    step = max(1, min(ROWS, (1 << 20) // width))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            entries = pc.list_flatten(part.column("embedding")).to_numpy(zero_copy_only=False).astype(np.float64)
            yield part.column("vec_id"), integers(entries.reshape(part.num_rows, width))


def _packed(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    texts = [",".join(map(str, map(int, v))) for v in sums.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(texts, pa.string())], ["key", "sums"])


def _added(partial: DataFrame) -> dict[int, list[int]]:
    """Sums of the tasks' integer rows by key; the rows of a key stream through one task, only the sums come to the driver: one row for each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                more = np.array(list(map(int, text.split(","))), dtype=object)
                sums[key] = sums[key] + more if key in sums else more
        yield _packed(sums)

    return {r["key"]: [int(v) for v in r["sums"].split(",")] for r in partial.repartition("key").mapInArrow(run, "key int, sums string").collect()}


def fit_list(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id and embedding of the vectors that take part, and their width; 0 if there are none."""
    sound = vectors.selectExpr("CAST(vec_id AS bigint) AS vec_id", "embedding").where("embedding IS NOT NULL AND size(embedding) > 0 AND NOT exists(embedding, e -> e IS NULL OR isnan(e) OR abs(CAST(e AS double)) = double('infinity'))")
    widths = sound.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    if not widths:
        return sound, 0
    return sound.where(F.size("embedding") == widths[0]["width"]), widths[0]["width"]


def moments(rows: DataFrame, width: int) -> tuple[int, list[int], np.ndarray]:
    """n, the sums S of x in each dimension, and the matrix of n * sum((x - S/n)_i * (x - S/n)_j): all exact."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, dtype=object)
        for _, x in _blocks(batches, width):
            n += len(x)
            small = x.dtype == np.int64 and np.abs(x).max() < 1 << 49  # times at most 2 ** 13 rows
            total = total + (x.sum(0) if small else x.astype(object).sum(0)).astype(object)
        if n:
            yield _packed({0: np.array([n, *total], dtype=object)})

    n, *totals = _added(rows.mapInArrow(sums, "key int, sums string"))[0]
    middle = [(2 * s + n) // (2 * n) for s in totals]  # the mean, as a whole number

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, some = ExactSum(width, width), False
        for _, x in _blocks(batches, width):
            w, some = centred(x, middle), True
            gram.add(w, w)
        if some:
            yield _packed(dict(enumerate(gram.value())))

    by_row = _added(rows.mapInArrow(products, "key int, sums string"))
    gram = np.array([by_row[i] for i in range(width)], dtype=object).reshape(width, width)
    left = np.array([s - n * m for s, m in zip(totals, middle, strict=True)], dtype=object)  # sums of x - middle: below n each
    return n, totals, n * gram - np.outer(left, left)


class _Projection:
    """What a task needs to whiten rows: n, S and the components."""

    def __init__(self, n: int, totals: list[int], values: np.ndarray, vectors: np.ndarray):
        self.n, self.middle = n, [(2 * s + n) // (2 * n) for s in totals]
        self.left = [s - n * m for s, m in zip(totals, self.middle, strict=True)]
        self.rest = np.array([v / n for v in self.left])
        self.turn = vectors / np.sqrt(values)

    def whitened(self, w: np.ndarray) -> np.ndarray:
        return (w.astype(np.float64) - self.rest) @ self.turn

    def deviation(self, w: np.ndarray) -> list[int | None]:
        """Sum of (n*x - S) ** 2; None where that is no 64-bit integer."""
        most = int(np.abs(w).max()) if w.size else 0
        if w.dtype == np.int64 and (self.n * (most + 1)) ** 2 * w.shape[1] < 1 << 63:
            z = w * self.n - np.array(self.left, np.int64)
            return (z * z).sum(1).tolist()
        z = w.astype(object) * self.n - np.array(self.left, dtype=object)
        return [v if (v := int(s)) < 1 << 63 else None for s in (z * z).sum(1)]


def _joined(a: tuple, b: tuple) -> tuple:
    """Counts, means and centred products of two parts of the rows as those of both."""
    n = a[0] + b[0]
    apart = b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def identity_error(rows: DataFrame, width: int, project: _Projection) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    middle, held = project.middle, project.turn.shape[1]
    schema = "stream int, n long, mean array<double>, products array<double>"

    def batch_of(stream: int, part: tuple) -> pa.RecordBatch:
        lists = [pa.array([v.ravel().tolist()], pa.list_(pa.float64())) for v in part[1:]]
        return pa.RecordBatch.from_arrays([pa.array([stream], pa.int32()), pa.array([part[0]], pa.int64()), *lists], ["stream", "n", "mean", "products"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for _, x in _blocks(batches, width):
            z = project.whitened(centred(x, middle))
            mean = z.mean(0)
            part = len(z), mean, (z - mean).T @ (z - mean)
            total = part if total is None else _joined(total, part)
        if total is not None:
            yield batch_of(TaskContext.get().partitionId() % STREAMS, total)

    def read(r: dict) -> tuple:
        return r["n"], np.array(r["mean"]), np.array(r["products"]).reshape(held, held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for r in batch.to_pylist():
                total = read(r) if total is None else _joined(total, read(r))
        if total is not None:
            yield batch_of(0, total)

    total = None
    for r in rows.mapInArrow(parts, schema).repartition(STREAMS, "stream").mapInArrow(merge, schema).collect():  # at most a row for each stream
        total = read(r) if total is None else _joined(total, read(r))
    return float(np.abs(total[2] / total[0] - np.eye(held)).max())


def whiten(vectors: DataFrame, most: int = 32) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error: a row for each vector that takes part and each of its first `most` components.

    Vectors that are null, empty or hold null or non-finite entries take no part, nor do those of
    another width than most have (of equally common widths the smaller counts). Components end at the
    rank of the covariance: with one vector, equal vectors or none there is no row. A deviation that is
    no 64-bit integer is null. Repeated rows count and are returned each, null ids too; equal
    eigenvalues come in an order that one run keeps. Other columns are not carried, whatever their
    names. A task holds about a million entries of vectors and a few matrices as wide as a vector.
    """
    rows, width = fit_list(vectors)
    spark = common.session_of(vectors)
    if not width:
        return spark.createDataFrame([], RESULT)
    rows = common.spread(rows)
    n, totals, scatter = moments(rows, width)
    values, basis = components(scatter, n, most)
    held = len(values)
    if not held:
        return spark.createDataFrame([], RESULT)
    project = _Projection(n, totals, values, basis)
    error = identity_error(rows, width, project)
    explained = values / (int(np.trace(scatter)) / (n * n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches, width):
            w = centred(x, project.middle)
            size = len(w)
            each = pa.array(np.repeat(np.arange(size), held))
            columns = [ids.take(each), pa.array(np.tile(np.arange(1, held + 1, dtype=np.int32), size)), pa.array(np.full(size * held, n, np.int64))]
            columns += [pa.array(project.deviation(w), pa.int64()).take(each), pa.array(project.whitened(w).ravel()), pa.array(np.tile(explained, size)), pa.array(np.full(size * held, error))]
            yield pa.RecordBatch.from_arrays(columns, RESULT.replace(" long", "").replace(" int", "").replace(" double", "").split(", "))

    return rows.mapInArrow(run, RESULT)
