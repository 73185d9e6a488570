"""Facts of several kinds put into a prompt: every kind gets its share of a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marginalia.functions import numbers


def shares(totals: DataFrame, keys: list[str], kind: str, size: str, budget: int) -> DataFrame:
    """totals (keys, kind, size) with `share`: what each kind gets of the budget, so that small kinds get all they need and the others the same (water filling).

    Kinds are filled by rising size: one that needs less than an equal part of what is left gets all of
    it; the first that needs more sets the level for itself and all after it.
    """
    w = Window.partitionBy(*keys).orderBy(size, kind)
    before = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.count("*").over(Window.partitionBy(*keys)) - F.row_number().over(w) + 1
    level = totals.withColumn("_level", F.floor((budget - before) / left)).withColumn("_over", F.col("_level") < F.col(size))
    first = F.first(F.when(F.col("_over"), F.col("_level")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return level.withColumn("share", F.when(first.isNull(), F.col(size)).otherwise(F.greatest(first, F.lit(0))).cast("long")).drop("_level", "_over")


def chosen(facts: DataFrame, keys: list[str], kind: str, order: list, size: Column, budget: int) -> DataFrame:
    """The facts that a prompt of `budget` characters has room for.

    Each kind keeps the longest prefix (by order) within its share; what the shares leave over goes to
    the facts that come next, kind by kind, as long as they fit. Sizes are summed by windows; no group is
    held as an array. The sum of the sizes never passes the budget.
    """
    sized = facts.withColumn("_size", size.cast("long"))
    parts = shares(sized.groupBy(*keys, kind).agg(F.sum("_size").alias("_all")), keys, kind, "_all", budget).select(*keys, kind, "share")
    upto = Window.partitionBy(*keys, kind).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = sized.join(parts, [*keys, kind]).withColumn("_upto", F.sum("_size").over(upto)).withColumn("_in", F.col("_upto") <= F.col("share"))
    spent = F.sum(F.when(F.col("_in"), F.col("_size")).otherwise(0)).over(Window.partitionBy(*keys))
    rest = Window.partitionBy(*keys).orderBy(kind, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    more = F.sum(F.when(F.col("_in"), 0).otherwise(F.col("_size"))).over(rest)
    return ranked.withColumn("_spent", spent).withColumn("_more", more).where(F.col("_in") | (F.col("_spent") + F.col("_more") <= budget)).drop("_size", "share", "_upto", "_in", "_spent", "_more")


def prompt(facts: DataFrame, keys: list[str], kind: str, order: list[str], text: str, budget: int, rules: str | None = None, exact: Column | None = None) -> DataFrame:
    """keys and prompt: chosen facts under their kinds, then the rules. Numbers are made plain, but where exact is true.

    A fact counts with its bullet and line end, so that a prompt's facts are never longer than the budget.
    """
    plain = numbers.tidy(F.col(text)) if exact is None else F.when(exact, F.col(text)).otherwise(numbers.tidy(F.col(text)))
    lines = facts.where(F.trim(text) != "").withColumn("_line", F.concat(F.lit("- "), plain))
    kept = chosen(lines, keys, kind, order, F.length("_line") + 1, budget)
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*c))), lambda x: x["_line"]), "\n")  # noqa: E731  bounded by the budget
    by_kind = kept.groupBy(*keys, kind).agg(joined([*order, "_line"]).alias("_line")).withColumn("_line", F.concat(F.lit("["), F.col(kind), F.lit("]\n"), F.col("_line")))
    tail = F.lit("" if rules is None else f"\n[Rules]\n{rules}")
    return by_kind.groupBy(*keys).agg(F.concat(F.lit("[Facts]\n"), joined([kind, "_line"]), tail).alias("prompt"))
