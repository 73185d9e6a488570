"""Tables as cells: one row for each (table_id, row_idx, col_idx, cell)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marginalia.functions import numbers


#: Rows that one task sorts, so that its memory does not grow with the table.
ROWS = 500_000


def melt(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """keys, row_idx (by order, from 1), col_idx, header and value of every cell of the named columns."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS))
    rows = rows.repartition(parts, *keys).withColumn("row_idx", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    cells = F.array(*[F.struct(F.lit(i).alias("col_idx"), F.lit(c).alias("header"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns)])
    return rows.select(*keys, "row_idx", F.explode(cells).alias("c")).select(*keys, "row_idx", "c.col_idx", "c.header", "c.value")


def column_stats(cells: DataFrame, keys: list[str]) -> DataFrame:
    """count, sum, mean, min, max of each column that is numeric: at least max(1, floor(0.6 * rows)) cells hold a number."""
    stats = cells.groupBy(*keys, "col_idx").agg(
        F.count("*").alias("rows"), F.count("value").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 4).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most")
    )
    return stats.where(F.col("n") >= F.greatest(F.lit(1), F.floor(F.col("rows") * 0.6)))


def percent_columns(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Adds percent and share to cells (value, had): a column is percent if half of its cells or more have the sign, or if none has and at least 3 values, four fifths of them in [0, 1.2], or all in [0, 100] with a sum near 100."""
    column = Window.partitionBy(*keys, "col_idx")
    n, signed = F.count("value").over(column), F.count_if(F.col("had")).over(column)
    small = F.count_if(F.col("value").between(0, 1.2)).over(column)
    percent = (signed * 2 >= n) & (signed > 0) | (signed == 0) & (n >= 3) & (small >= F.ceil(n * 0.8))
    share = F.when(F.col("percent") & (F.col("value") > 1.2), F.col("value") / 100).otherwise(F.col("value"))
    return cells.withColumn("percent", percent).withColumn("share", F.when(F.col("percent"), share).otherwise(F.col("value")))


def has_header(rows: DataFrame, keys: list[str], cells: str, row: str) -> DataFrame:
    """Whether each table's first row is a header: at most a quarter of its cells are numbers, and two fifths or more of one of the next three rows'."""
    numeric = F.size(F.filter(cells, lambda c: numbers.plain_number(c).isNotNull())) / F.greatest(F.size(cells), F.lit(1))
    return rows.where(F.col(row) <= 4).groupBy(*keys).agg(((F.max(F.when(F.col(row) == 1, numeric)) <= 0.25) & (F.coalesce(F.max(F.when(F.col(row) > 1, numeric)), F.lit(0.0)) >= 0.4)).alias("has_header"))


def markdown(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))


def csv_line(cells: Column) -> Column:
    quoted = lambda c: F.when(c.rlike("[\",\n]"), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return F.array_join(F.transform(cells, quoted), ",")


def quality(filled: Column, numeric: Column) -> Column:
    """Recognition quality of a table from its shares of filled and of numeric cells."""
    return F.when((filled < 0.25) | (numeric < 0.20), "low").when((filled < 0.45) | (numeric < 0.35), "mid").otherwise("high")


def recognised(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, the shares of filled and of numeric cells among all cells of a table's rows (`cells`), and its quality."""
    filled = F.size(F.filter("cells", lambda c: F.trim(c) != ""))
    numeric = F.size(F.filter("cells", lambda c: numbers.cell_number(c).isNotNull()))
    shares = rows.groupBy(*keys).agg(F.round(F.sum(filled) / F.sum(F.size("cells")), 4).alias("filled"), F.round(F.sum(numeric) / F.sum(F.size("cells")), 4).alias("numeric"))
    return shares.withColumn("quality", quality(F.col("filled"), F.col("numeric")))


def recognised_csv(text: Column) -> Column:
    """Lines of recognised text as CSV: cells at bars or at two spaces, all rows padded to the widest."""
    rows = F.transform(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), lambda x: F.transform(F.split(F.trim(x), r"\s*\|\s*|\s{2,}"), lambda c: F.trim(c)))
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    padded = lambda w: F.transform(rows, lambda r: csv_line(F.concat(r, F.array_repeat(F.lit(""), w - F.size(r)))))
    return F.array_join(F.element_at(F.transform(F.array(width), padded), 1), "\n")
