"""Ordered operators: fill-forward, round robin, head and tail, slices, repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def fill_forward(rows: DataFrame, keys: list[str], order: str, found: Column, name: str) -> DataFrame:
    """Each row gets the last value found at or before it."""
    past = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.last(found, ignorenulls=True).over(past))


def round_robin(rows: DataFrame, keys: list[str], bucket: str, order: list, per_bucket: int | None = None) -> DataFrame:
    """Adds `rank` in the bucket and `place`: first all rows of rank 1 by bucket, then of rank 2, and so on."""
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order)))
    if per_bucket is not None:
        rows = rows.where(F.col("rank") <= per_bucket)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("rank", bucket)))


def head_and_tail(rows: DataFrame, keys: list[str], order: str, k: int) -> DataFrame:
    """Of each group of more than k rows the first ceil(k / 2) and the last of the rest; all of a smaller group."""
    w = Window.partitionBy(*keys)
    head = -(-k // 2)
    rows = rows.withColumn("_at", F.row_number().over(w.orderBy(order))).withColumn("_n", F.count("*").over(w))
    return rows.where((F.col("_n") <= k) | (F.col("_at") <= head) | (F.col("_at") > F.col("_n") - (k - head))).drop("_at", "_n")


def middle(rows: DataFrame, keys: list[str], order: str, low: float, high: float, most: int) -> DataFrame:
    """Rows from floor(low * n) to floor(high * n) of each group, at most `most`."""
    w = Window.partitionBy(*keys)
    rows = rows.withColumn("_at", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    first = F.floor(F.col("_n") * low)
    return rows.where((F.col("_at") >= first) & (F.col("_at") < F.floor(F.col("_n") * high)) & (F.col("_at") < first + most)).drop("_at", "_n")


def without_repeats(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Drops blank values, then each that equals the one kept before it."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = rows.where(F.trim(F.col(value)) != "")
    return rows.withColumn("_before", F.lag(value).over(w)).where(~F.col("_before").eqNullSafe(F.col(value))).drop("_before")
