"""Attributes kept as JSON of any shape: paths with fallbacks, and charts and grids in whatever form they come."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

POINT = "array<struct<series:string,label:string,value:double,unit:string>>"
# The names under which attributes hold the same thing.
LABELS, VALUES, UNITS = ["label", "name", "category", "x"], ["value", "val", "y"], ["unit", "units"]
CHARTS = ["chart_data", "chart_matrix", "values"]
CATEGORIES, DATA = ["categories", "labels"], ["values", "data"]


def parsed(attrs: Column) -> Column:
    """The attributes as a variant; null for broken text, an empty text and null."""
    return F.try_parse_json(attrs)


def first_of(variant: Column, names: list[str], kind: str, where: str = "$") -> Column:
    """The first of several members that is there and fits a type."""
    return F.coalesce(*[F.try_variant_get(variant, f"{where}.{name}", kind) for name in names])


def points(chart: Column) -> Column:
    """array of struct(series, label, value, unit) of a chart in any of these forms; null if it is none.

    A list of objects (label, value, unit, series_name) or of pairs [label, value]; categories with a list
    of series (name, values, unit), or with one list of values; an object whose members are the labels.
    Names may be any of those above. A value that is no number is null, as are missing ones of a series.
    """
    none = F.lit(None).cast(POINT)
    point = lambda series, label, value, unit: F.struct(series.alias("series"), label.alias("label"), value.alias("value"), unit.alias("unit"))
    text = F.lit(None).cast("string")
    unit = first_of(chart, UNITS, "string")
    items = F.try_variant_get(chart, "$", "array<variant>")

    def listed(x: Column) -> Column:
        label = F.coalesce(first_of(x, LABELS, "string"), F.try_variant_get(x, "$[0]", "string"))
        value = F.coalesce(first_of(x, VALUES, "double"), F.try_variant_get(x, "$[1]", "double"))
        return point(first_of(x, ["series_name", "series"], "string"), label, value, first_of(x, UNITS, "string"))

    categories = first_of(chart, CATEGORIES, "array<string>")
    series = F.try_variant_get(chart, "$.series", "array<variant>")

    def of_series(s: Column) -> Column:
        values = F.coalesce(first_of(s, DATA, "array<double>"), F.try_variant_get(s, "$", "array<double>"))
        own = F.coalesce(first_of(s, UNITS, "string"), unit)
        return F.transform(categories, lambda c, k: point(first_of(s, ["name", "title"], "string"), c, F.get(values, k), own))

    single = first_of(chart, DATA, "array<double>")
    gridded = F.when(series.isNotNull(), F.flatten(F.transform(series, of_series))).when(single.isNotNull(), F.transform(categories, lambda c, k: point(text, c, F.get(single, k), unit)))
    members = F.map_entries(F.try_variant_get(chart, "$", "map<string,variant>"))
    mapped = F.transform(F.filter(members, lambda m: F.try_variant_get(m["value"], "$", "double").isNotNull()), lambda m: point(text, m["key"], F.try_variant_get(m["value"], "$", "double"), unit))
    found = F.when(items.isNotNull(), F.filter(F.transform(items, listed), lambda p: p["label"].isNotNull())).when(categories.isNotNull(), gridded).when(members.isNotNull(), mapped)
    return F.coalesce(found, none)


def chart_points(rows: DataFrame, key: str, attrs: str) -> DataFrame:
    """key, place, series, label, value, unit of the charts that attributes (JSON text) hold under the first of CHARTS that is one; broken and chartless ones give no rows."""
    v = parsed(F.col(attrs))
    found = [points(F.try_variant_get(v, f"$.{name}", "variant")) for name in CHARTS]
    filled = [F.when(F.size(p) > 0, p) for p in found]
    return rows.select(key, F.posexplode(F.coalesce(*filled)).alias("place", "p")).select(key, "place", "p.series", "p.label", "p.value", "p.unit")


def grid_rows(rows: DataFrame, key: str, attrs: str) -> DataFrame:
    """key, row_idx and cells of the tables that attributes hold as table_rows or cells: lists of lists, or of objects, whose members in order of name are the cells below a row of the names."""
    v = parsed(F.col(attrs))
    lines = first_of(v, ["table_rows", "cells", "rows"], "array<variant>")
    cells = lambda x: F.try_variant_get(x, "$", "array<string>")
    names = F.array_sort(F.map_keys(F.try_variant_get(F.get(lines, F.lit(0)), "$", "map<string,string>")))
    members = lambda x: F.transform(names, lambda n: F.try_element_at(F.try_variant_get(x, "$", "map<string,string>"), n))
    as_lists = F.filter(F.transform(lines, cells), lambda c: c.isNotNull())
    as_objects = F.concat(F.array(names), F.transform(lines, members))
    found = F.when(F.size(as_lists) > 0, as_lists).when(F.size(names) > 0, as_objects)
    return rows.select(key, F.posexplode(found).alias("row_idx", "cells"))


def shape(rows: DataFrame, attrs: str) -> DataFrame:
    """One row: the schema that all attributes together have, and how many are broken."""
    v = parsed(F.col(attrs))
    return rows.agg(F.schema_of_variant_agg(v).alias("schema"), F.count_if(v.isNull() & (F.trim(attrs) != "")).alias("broken"))
