"""Sharding by Karmarkar-Karp differencing: shards of near-equal bytes from indivisible groups.

Equal texts form a group and stay together. Groups of at least 1/units_per_shard of a shard are
units of their own (at most n_shards * units_per_shard of them); all smaller groups are bundled by
hash into n_shards * units_per_shard units. Differencing runs on the units, whose number depends
on the parameters and not on the data, so that the driver holds a bounded table at any size.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import common

#: Bytes that a document counts besides its text.
ROW_BYTES = 16


def differencing(sizes: list[int], k: int) -> list[int]:
    """The part (0 to k-1) of each size, by k-way Karmarkar-Karp differencing.

    The two partial partitions of largest spread are combined again and again, the heaviest part
    of one with the lightest of the other. Ties go to the older partial partition.
    """
    if not sizes:
        return []
    if k == 1:
        return [0] * len(sizes)
    heap, made = [], []
    for i, size in enumerate(sizes):
        sums = np.zeros(k)
        sums[0] = size
        heap.append((-float(size), i, sums))
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        both = x + y[::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        made.append((a, b, order))
        heapq.heappush(heap, (float(both[-1] - both[0]), n + len(made) - 1, both))
    place: dict[int, np.ndarray] = {heap[0][1]: np.arange(k)}
    parts = [0] * n
    for i in range(len(made) - 1, -1, -1):
        a, b, order = made[i]
        final = place.pop(n + i)
        left = np.empty(k, np.int64)
        left[order] = final
        place[a], place[b] = left, left[::-1]
    for i in range(n):
        parts[i] = int(place[i][0])
    return parts


def shard_by_bytes(docs: DataFrame, n_shards: int = 40, units_per_shard: int = 64) -> DataFrame:
    """Every row of documents with its shard: doc_id, size, text_crc32, shard, slot.

    size: UTF-8 bytes of the text plus 16; text_crc32 of an empty text for null. slot: gapless from
    0 in each shard, by doc_id, size and checksum; rows that tie in all three are equal and get
    slots in any order. Null texts form one group of their own, a null doc_id comes first. An empty
    table gives an empty result; other columns are not carried.
    """
    spark, units = common.session_of(docs), n_shards * units_per_shard
    size = common.byte_size() + ROW_BYTES
    rows = docs.select(
        "doc_id", size.alias("size"), F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"), F.xxhash64(F.col("text").isNull(), "text").alias("_group")
    )
    rows = common.cut(rows)
    groups = rows.groupBy("_group").agg(F.sum("size").alias("_bytes"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    large = groups.where(F.col("_bytes") * units >= max(total, 1)).withColumn("_unit", F.col("_group"))
    # at most n_shards * units_per_shard groups can be as large, so this broadcast is bounded
    united = rows.join(F.broadcast(large.select("_group", "_unit")), "_group", "left")
    united = united.withColumn("_large", F.col("_unit").isNotNull()).withColumn("_unit", F.coalesce("_unit", F.pmod(F.xxhash64("_group"), F.lit(units))))
    sums = united.groupBy("_large", "_unit").agg(F.sum("size").alias("_bytes")).orderBy(F.desc("_bytes"), "_large", "_unit").collect()
    parts = differencing([r["_bytes"] for r in sums], n_shards)
    plan = spark.createDataFrame([(r["_large"], r["_unit"], p) for r, p in zip(sums, parts, strict=True)], "_large boolean, _unit long, shard int")
    placed = united.join(F.broadcast(plan), ["_large", "_unit"]).select("doc_id", "size", "text_crc32", "shard")
    return common.numbered(placed, "shard", ["doc_id", "size", "text_crc32"], "slot")
