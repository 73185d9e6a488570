"""Places of patterns in texts, and which of overlapping ones count."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SPAN = "array<struct<start:int,length:int,kind:string,text:string>>"


def found(text: Column, pattern: str, kind: str) -> Column:
    """array of struct(start, length, kind, text): all matches of a pattern from left to right, start from 1. Null has none.

    A match's place is the sum of what lies before it: the gaps that splitting by the pattern leaves, and the matches.
    """
    gaps, hits = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(gaps, hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + part["gap"]
        span = F.struct(start.alias("start"), F.length(part["hit"]).alias("length"), F.lit(kind).alias("kind"), part["hit"].alias("text"))
        return F.struct((start + F.length(part["hit"])).alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    begin = F.struct(F.lit(1).alias("at"), F.array().cast(SPAN).alias("out"))
    return F.coalesce(F.aggregate(F.filter(parts, lambda p: p["hit"].isNotNull() & (p["hit"] != "")), begin, step, lambda s: s["out"]), F.array().cast(SPAN))


def resolved(*spans: Column) -> Column:
    """Spans of several patterns without overlaps: from left to right, the longest of those that begin first; of equal ones the first pattern's."""

    def ranked(k: int):
        return lambda x: F.struct(x["start"].alias("start"), (-x["length"]).alias("shorter"), F.lit(k).alias("rank"), x["kind"].alias("kind"), x["text"].alias("text"))

    def step(state: Column, x: Column) -> Column:
        span = F.struct(x["start"].alias("start"), (-x["shorter"]).alias("length"), x["kind"].alias("kind"), x["text"].alias("text"))
        free = x["start"] >= state["end"]
        return F.struct(F.when(free, x["start"] - x["shorter"]).otherwise(state["end"]).alias("end"), F.when(free, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    begin = F.struct(F.lit(1).alias("end"), F.array().cast(SPAN).alias("out"))
    return F.aggregate(F.sort_array(F.concat(*[F.transform(s, ranked(k)) for k, s in enumerate(spans)])), begin, step, lambda s: s["out"])


def of_patterns(text: Column, patterns: dict[str, str]) -> Column:
    """resolved() over named patterns; a pattern's name is the kind of its spans."""
    return resolved(*[found(text, p, k) for k, p in patterns.items()])


