"""Charts and grids in attributes of mixed shapes."""

from __future__ import annotations

from marginalia.functions import variants

ROWS = [
    (1, '{"chart_data": [{"label": "a", "value": 1.5, "unit": "%"}, {"name": "b", "y": 2, "series_name": "s"}, {"value": 3}]}'),
    (2, '{"chart_data": [["a", 1], ["b", "x"]]}'),
    (3, '{"chart_data": {"categories": ["a", "b"], "unit": "шт", "series": [{"name": "s", "values": [1, 2]}, {"title": "t", "data": [3], "unit": "%"}]}}'),
    (4, '{"chart_matrix": {"labels": ["a"], "values": [7]}}'),
    (5, '{"values": {"a": 1, "b": "no", "c": 2.5}}'),
    (6, "{broken"), (7, None), (8, ""), (9, '{"chart_data": "text"}'), (10, '{"chart_data": [], "chart_matrix": {"labels": ["z"], "values": [1]}}'), (11, "[1, 2]"),
]


def test_charts_of_any_shape(spark):
    rows = spark.createDataFrame(ROWS, "id int, attrs string")
    got = {}
    for r in variants.chart_points(rows, "id", "attrs").orderBy("id", "place").collect():
        got.setdefault(r["id"], []).append((r["series"], r["label"], r["value"], r["unit"]))
    assert got == {
        1: [(None, "a", 1.5, "%"), ("s", "b", 2.0, None)],
        2: [(None, "a", 1.0, None), (None, "b", None, None)],
        3: [("s", "a", 1.0, "шт"), ("s", "b", 2.0, "шт"), ("t", "a", 3.0, "%"), ("t", "b", None, "%")],
        4: [(None, "a", 7.0, None)],
        5: [(None, "a", 1.0, None), (None, "c", 2.5, None)],
        10: [(None, "z", 1.0, None)],
    }
    told = variants.shape(rows, "attrs").first()
    assert told["broken"] == 1 and "VARIANT" in told["schema"].upper()


def test_grids_of_any_shape(spark):
    rows = [(1, '{"table_rows": [["h", "2020"], ["a", 5], ["b", null]]}'), (2, '{"cells": [{"x": 1, "y": "q"}, {"y": "r"}]}'), (3, '{"rows": 5}'), (4, "{"), (5, None)]
    got = {}
    for r in variants.grid_rows(spark.createDataFrame(rows, "id int, attrs string"), "id", "attrs").orderBy("id", "row_idx").collect():
        got.setdefault(r["id"], []).append(list(r["cells"]))
    assert got == {1: [["h", "2020"], ["a", "5"], ["b", None]], 2: [["x", "y"], ["1", "q"], [None, "r"]]}
