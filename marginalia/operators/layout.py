"""Grids from recognised words: boxes are grouped to lines and columns by the gaps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from marginalia.operators import tables


def clustered(rows: DataFrame, keys: list[str], low: str, high: str, gap: float, name: str) -> DataFrame:
    """Adds `name`, the number from 0 of the group of intervals that a row's interval is in: a new one begins where none before reaches nearer than gap."""
    w = Window.partitionBy(*keys).orderBy(low, high)
    reach = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(F.col(low) - reach > gap, 1).otherwise(0)
    return rows.withColumn("_begins", begins).withColumn(name, F.sum("_begins").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")).drop("_begins")


def grid_of_words(words: DataFrame, keys: list[str], line_gap: float, column_gap: float) -> DataFrame:
    """keys, row_idx and cells (array, padded to the width of the table) of words with boxes (left, right, top, bottom, text).

    Lines are told by the words' middles, which jitter less than their edges: a line ends where the next
    middle is more than line_gap below. Columns are told by the words of all lines together: a column
    ends where no word reaches nearer than column_gap to the next. Words of a cell are joined by a
    space from left to right. A table is as large as a page: its rows meet in one window each for lines
    and columns, and only a line's words are held together. Blank words and boxes without places go.
    """
    boxes = words.where("left IS NOT NULL AND right IS NOT NULL AND top IS NOT NULL AND bottom IS NOT NULL AND trim(text) <> ''").withColumn("_middle", (F.col("top") + F.col("bottom")) / 2)
    lined = clustered(boxes, keys, "_middle", "_middle", line_gap, "row_idx")
    placed = clustered(lined, keys, "left", "right", column_gap, "_col")
    cells = placed.groupBy(*keys, "row_idx", "_col").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("left", "right", F.trim("text").alias("text")))), lambda x: x["text"]), " ").alias("cell"))
    width = F.max("_col").over(Window.partitionBy(*keys)) + 1
    lines = cells.withColumn("_width", width).groupBy(*keys, "row_idx", "_width").agg(F.map_from_entries(F.collect_list(F.struct("_col", "cell"))).alias("_cells"))
    return lines.select(*keys, "row_idx", F.transform(F.sequence(F.lit(0), F.col("_width") - 1), lambda k: F.coalesce(F.try_element_at("_cells", k), F.lit(""))).alias("cells"))


def with_recognised(grid: DataFrame, recognised: DataFrame, table: str = "table_id") -> DataFrame:
    """grid (table, row_idx, cells) with the recognised grids of tables that it has no rows of, if their quality is not low; quality is empty for tables of the document's own."""
    good = tables.recognised(recognised, [table]).where("quality <> 'low'").select(table, "quality")
    more = recognised.join(grid.select(table).distinct(), table, "left_anti").join(good, table).select(table, "row_idx", "cells", "quality")
    return grid.select(table, "row_idx", "cells", F.lit("").alias("quality")).unionByName(more)
