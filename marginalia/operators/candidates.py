"""Chunks that may hold evidence for a calculation, and sections where a document has too few of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from marginalia.functions import numbers

# Kinds of chunks, stems of contexts in which numbers are facts, and limits.
KINDS = ["table", "table_row", "paragraph", "text"]
MONEY = ["руб", "тыс", "млн", "млрд", "выруч", "доход", "расход", "затрат", "прибыл", "итог", "сумм", "баланс"]
SHARES = ["структур", "удельн", "доля", "распредел", "состав", "соотнош", "процент", "опрос", "респонд"]
MOST_CHUNKS, MOST_SECTIONS, LEAST = 140, 220, 5
NUMBER = r"\d+(?:[.,]\d+)?"
OPERATION = rf"{NUMBER}\s*[-+−*/×=]\s*{NUMBER}"
#: Characters by which two candidates of one place are told apart.
COMPARED = 400


def _any(text: Column, stems: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(s) for s in stems])


def fits(text: Column, weak: bool = False) -> Column:
    """Whether a text may hold evidence: it has a number or a word about money, and its numbers are not all years or small indexes, unless it is about money, counts, or (not if weak) is about shares."""
    low = F.lower(F.coalesce(text, F.lit("")))
    values = F.transform(F.regexp_extract_all(low, F.lit(NUMBER), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit(".")).cast("double"))
    about = _any(low, MONEY) | low.rlike(OPERATION)
    if not weak:
        about = about | low.contains("%") | _any(low, SHARES)
    dull = F.forall(values, lambda v: numbers.is_year(v) | numbers.is_small_index(v))
    return (low.rlike("[0-9]") | _any(low, MONEY)) & (about | ~dull)


def of_chunks(chunks: DataFrame, keys: list[str], most: int = MOST_CHUNKS) -> DataFrame:
    """keys, id, element_type, section_path and text of a document's first `most` chunks that fit."""
    kind = F.coalesce(F.nullif(F.col("element_type"), F.lit("")), F.lit("paragraph"))
    found = chunks.where(kind.isin(KINDS) & fits(F.col("text"))).withColumn("element_type", kind)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
    return found.withColumn("_n", place).where(F.col("_n") <= most).select(*keys, "id", "element_type", "section_path", "text")


def with_sections(candidates: DataFrame, sections: DataFrame, keys: list[str], least: int = LEAST, most: int = MOST_SECTIONS) -> DataFrame:
    """candidates, and for documents with fewer than `least` of them the sections that fit under the weaker rule; each (type, path, text) once, as far as its first characters tell, a chunk before a section."""
    counts = candidates.groupBy(*keys).agg(F.count("*").alias("_have"))
    poor = sections.join(counts.where(F.col("_have") >= least).select(*keys), keys, "left_anti")
    kind = F.coalesce(F.nullif(F.col("element_type"), F.lit("")), F.lit("paragraph"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
    more = poor.where(fits(F.col("text"), weak=True)).withColumn("element_type", kind).withColumn("_n", place).where(F.col("_n") <= most)
    every = candidates.withColumn("_k", F.lit(0)).unionByName(more.select(*keys, "id", "element_type", "section_path", "text", F.lit(1).alias("_k")))
    told = F.left(F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))), F.lit(COMPARED))
    first = Window.partitionBy(*keys, "element_type", "section_path", "_told").orderBy("_k", "id")
    return every.withColumn("_told", told).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_told", "_n").withColumnRenamed("_k", "from_sections")
