"""Nearest vectors of a block of queries among a lane of rows, on Arrow tables inside a task."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows and queries that are multiplied at once, and pairs whose exact products are summed at once.
ROWS, QUERIES, PAIRS = 4096, 1024, 100_000
#: How far below the k-th a similarity may lie and still round to it at six digits, with room for the error of the fast product.
MARGIN = 2e-6


def _by_width(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the vectors of each width; those that are null or hold a null are at -1."""
    vectors = column.combine_chunks()
    flat, size = vectors.flatten(), np.array(pc.fill_null(pc.list_value_length(vectors), -1), dtype=np.int64)
    if flat.null_count:
        size[pc.list_parent_indices(vectors).filter(flat.is_null()).to_numpy()] = -1
    out = {}
    for width in np.unique(size).tolist():
        places = np.flatnonzero(size == width)
        values = vectors.take(pa.array(places)).flatten().to_numpy(zero_copy_only=False).reshape(len(places), width) if width >= 0 else np.zeros((len(places), 0))
        out[width] = places, values
    return out


def _ranks(changed: np.ndarray) -> np.ndarray:
    """The rank of each element within its run; changed: where a run begins."""
    at = np.arange(len(changed))
    return at - np.maximum.accumulate(np.where(changed, at, 0))


def _apart(values: np.ndarray, k: int) -> np.ndarray:
    """The rows but those behind k equal ones, or behind k with a NaN, as any query finds these first."""
    n, width = values.shape
    if width == 0 or n == 0:
        return np.arange(min(n, k))
    kind = np.unique(np.ascontiguousarray(values).view(np.dtype((np.void, width * values.itemsize))).ravel(), return_inverse=True)[1].ravel()
    kind[np.isnan(values).any(axis=1)] = -1
    order = np.argsort(kind, kind="stable")
    return np.sort(order[_ranks(np.r_[True, kind[order][1:] != kind[order][:-1]]) < k])


def _sums(rows: np.ndarray, queries: np.ndarray, j: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Dot products of pairs, added from the first component to the last."""
    out = np.zeros(len(i))
    for s in range(0, len(i), PAIRS):
        a, b, part = rows[j[s : s + PAIRS]], queries[i[s : s + PAIRS]], out[s : s + PAIRS]
        for d in range(rows.shape[1]):
            part += a[:, d] * b[:, d]
    return out


def _undominated(j: np.ndarray, k: int) -> np.ndarray:
    """Which rows, from the nearest on, do not lie behind k smaller ones that are as near."""
    held: list[int] = []
    keep = np.zeros(len(j), dtype=bool)
    for at, row in enumerate(j.tolist()):
        if len(held) < k:
            heapq.heappush(held, -row)
        elif row < -held[0]:
            heapq.heapreplace(held, -row)
        else:
            continue
        keep[at] = True
    return keep


def _best(rows: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries, rows and exact similarities of all pairs that can be among a query's k best after rounding, ties to the smaller row.

    A fast product says which pairs come near the k-th of their query; only these are summed in order.
    """
    i, j, x = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    bound = np.full(len(queries), -np.inf)
    for start in range(0, len(rows), ROWS):
        part = rows[start : start + ROWS]
        near = queries @ part.T
        near[np.isnan(near)] = np.inf
        if start == 0 and len(part) >= k:
            bound = np.partition(near, len(part) - k, axis=1)[:, len(part) - k]
        new_i, new_j = np.nonzero(near >= (bound - MARGIN)[:, None])
        i, j, x = np.r_[i, new_i], np.r_[j, start + new_j], np.r_[x, _sums(part, queries, new_j, new_i)]
        odd = np.isnan(x)
        y = np.where(odd, np.inf, x)  # NaN is the greatest
        order = np.lexsort((j, -y, ~odd, i))
        i, j, x, y, odd = (a[order] for a in (i, j, x, y, odd))
        begins = np.r_[True, i[1:] != i[:-1]][: len(i)]
        kth = _ranks(begins) == k - 1
        bound[i[kth]] = np.maximum(bound[i[kth]], y[kth])
        keep = (_ranks(begins | np.r_[True, (y[1:] != y[:-1]) | (odd[1:] != odd[:-1])][: len(i)]) < k) & (y >= bound[i] - MARGIN)
        i, j, x = i[keep], j[keep], x[keep]
        crowded = np.flatnonzero(np.bincount(i, minlength=len(queries)) > 4 * k)
        if len(crowded):
            keep = np.ones(len(i), dtype=bool)
            for q in crowded:
                a, b = np.searchsorted(i, [q, q + 1])
                keep[a:b] = _undominated(j[a:b], k)
            i, j, x = i[keep], j[keep], x[keep]
    return i, j, x


def nearest(rows: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """q_id, id, sim (not rounded): of rows (id, v) all that can be among the k best of a query (q_id, qv) when rounded to six digits, ties to the smaller id.

    Without a whole vector on both sides, or with two widths, the similarity is null and comes last.
    """
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("id", "ascending")], null_placement="at_start"))
    held, found = _by_width(rows["v"]), []
    for width, (at, queries) in _by_width(asked["qv"]).items():
        places, values = held.get(width, (np.zeros(0, np.int64), np.zeros((0, max(width, 0))))) if width >= 0 else (np.zeros(0, np.int64), np.zeros((0, 0)))
        apart = _apart(values, k)
        few, values = places[apart], values[apart]
        for start in range(0, len(queries) if len(few) else 0, QUERIES):
            i, j, x = _best(values, queries[start : start + QUERIES], k)
            found.append((at[start + i], few[j], pa.array(x, from_pandas=False)))
        if len(places) < k:
            others = np.setdiff1d(np.arange(rows.num_rows), places)[: k - len(places)]
            found.append((np.repeat(at, len(others)), np.tile(others, len(at)), pa.nulls(len(at) * len(others), pa.float64())))
    if not found:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), pa.nulls(0, pa.float64()))]
    i, j = (pa.array(np.concatenate([f[n] for f in found])) for n in (0, 1))
    return pa.table({"q_id": asked["q_id"].take(i), "id": rows["id"].take(j), "sim": pa.chunked_array([f[2] for f in found])})
