"""Chunks shared out to the items of a question: quotas, exclusion, and what fills up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marginalia.sources.versions import cut


def allocated(hits: DataFrame, keys: list[str], item: str, chunk: str, order: list[Column | str], quota: int | None) -> DataFrame:
    """Each item's `quota` best chunks that no earlier item has (all of them without a quota), with their `rank`.

    Found in rounds: every item bids for its best candidates, a chunk goes to the first item that bids
    for it, and is struck from the lists of all later ones, whose quota then reaches further down; until
    nothing is struck. A chunk only ever goes to an earlier item, so that what is struck stays so, and
    there are at most as many rounds as items. Rows of equal (keys, item, chunk) are not expected.
    """
    place = F.row_number().over(Window.partitionBy(*keys, item).orderBy(*order))
    if quota is None:
        first = hits.withColumn("_first", F.min(item).over(Window.partitionBy(*keys, chunk))).where(F.col(item) == F.col("_first")).drop("_first")
        return first.withColumn("rank", place)
    left = cut(hits)
    while True:
        ranked = left.withColumn("rank", place)
        bidder = F.min(F.when(F.col("rank") <= quota, F.col(item))).over(Window.partitionBy(*keys, chunk))
        marked = cut(ranked.withColumn("_struck", F.coalesce(F.col(item) > bidder, F.lit(False))))
        if not marked.where("_struck").limit(1).count():
            return marked.where(F.col("rank") <= quota).drop("_struck")
        left = marked.where("NOT _struck").drop("_struck", "rank")


def covered(hits: DataFrame, overall: DataFrame, keys: list[str], item: str, chunk: str, order: list[Column | str], quota: int = 2, backfill: int = 4, wants_all: DataFrame | None = None) -> DataFrame:
    """Chunks for a question of several items in the order of their `place`: the items' first chunks in turn, then their second, up to the quota; what is left of items that want all values; then up to `backfill` of the whole question's hits that no item has.

    hits has the keys, item, chunk and what `order` reads, overall the same without item. wants_all:
    (keys, item) whose further candidates all count, as far as no other item has them; of several such
    items the first has a chunk. Backfilled rows have a null item.
    """
    best = cut(allocated(hits, keys, item, chunk, order, quota)).withColumn("_part", F.lit(0))
    parts = best
    if wants_all is not None:
        rest = hits.join(wants_all, [*keys, item], "left_semi").join(best.select(*keys, chunk), [*keys, chunk], "left_anti")
        parts = cut(parts.unionByName(allocated(rest, keys, item, chunk, order, None).withColumn("_part", F.lit(1))))
    more = overall.join(parts.select(*keys, chunk), [*keys, chunk], "left_anti").withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= backfill)
    parts = parts.unionByName(more.withColumn("_part", F.lit(2)), allowMissingColumns=True)
    turn = F.when(F.col("_part") == 0, F.col("rank")).otherwise(0)
    return parts.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("_part", turn, item, "rank"))).drop("_part")
