"""Labels and numbers of the same text brought together one to one, nearest first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from marginalia.sources.versions import cut


def nearest_pairs(left: DataFrame, right: DataFrame, keys: list[str], within: int) -> DataFrame:
    """keys, left_id, right_id and distance: one-to-one pairs of rows (keys, left_id, at) and (keys, right_id, at) at most `within` apart.

    In rounds, those are paired that are nearest to each other, and taken out, until none is left; of
    equal distances the smaller left_id, then the smaller right_id counts. This gives what taking all
    candidates by rising distance gives. Candidates are found by buckets as wide as the window, so that
    a text's labels meet the numbers near them only. Rows without a place have no partner.
    """
    placed = lambda df, name: df.where("at IS NOT NULL").select(*keys, name, F.col("at").alias(f"_{name}"), F.floor(F.col("at") / F.lit(within + 1)).alias("_bucket"))
    spread = placed(left, "left_id").withColumn("_bucket", F.explode(F.array(F.col("_bucket") - 1, F.col("_bucket"), F.col("_bucket") + 1)))
    pairs = spread.join(placed(right, "right_id"), [*keys, "_bucket"]).withColumn("distance", F.abs(F.col("_left_id") - F.col("_right_id"))).where(F.col("distance") <= within)
    open_ = cut(pairs.select(*keys, "left_id", "right_id", "distance"))
    done = []
    while True:
        order = ["distance", "left_id", "right_id"]
        first = lambda side: F.row_number().over(Window.partitionBy(*keys, side).orderBy(*order))
        mutual = cut(open_.withColumn("_a", first("left_id")).withColumn("_b", first("right_id")).where("_a = 1 AND _b = 1").select(*keys, "left_id", "right_id", "distance"))
        if not mutual.limit(1).count():
            break
        done.append(mutual)
        open_ = cut(open_.join(mutual.select(*keys, "left_id"), [*keys, "left_id"], "left_anti").join(mutual.select(*keys, "right_id"), [*keys, "right_id"], "left_anti"))
    out = open_.limit(0)
    for part in done:
        out = out.unionByName(part)
    return out
