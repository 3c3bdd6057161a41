"""Adaptive covers against the even-odd rule on whole outlines."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from diurnal.functions.shapes import RINGS_TYPE
from diurnal.operators import cover

from test_spatial import ELL, HOLE, SMALL, SQUARE, layer


def star(cx, cy, r, n, wobble=0.4):
    """A jagged outline of n corners."""
    at = [(cx + r * (1 - wobble * (k % 2)) * math.cos(2 * math.pi * k / n), cy + r * (1 - wobble * (k % 2)) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    return [*at, at[0]]


def holds(rings, x, y):
    """Even-odd rule on all edges, points on an edge included."""
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return True
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * ((y - y1) / (y2 - y1)) + x1:
                odd = not odd
    return odd


def expected(shapes, points):
    out = set()
    for i, x, y in points:
        own = {(i, name) for name, rings in shapes if x is not None and holds(rings, x, y)}
        out |= own or {(i, None)}
    return out


def found(spark, shapes, points):
    df = spark.createDataFrame(points, "id int, x double, y double").repartition(4)
    got = [(r["id"], r["name"]) for r in cover.locate(df, "x", "y", layer(spark, shapes), ["name"]).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("small", [True, False])
def test_points_on_edges_corners_and_in_holes(spark, small, request):
    if not small:
        request.getfixturevalue("no_broadcast")
    shapes = [("ring", [SQUARE, HOLE]), ("small", [SMALL]), ("ell", [ELL])]
    grid = [(100 * i + j, i / 4 - 0.5, j / 4 - 0.5) for i in range(26) for j in range(26)]
    points = [*grid, (9001, None, 1.0), (9002, 1e9, -1e9)]
    assert found(spark, shapes, points) == expected(shapes, points)


@pytest.mark.parametrize("most_edges", [4, 16])
def test_polygons_whose_sizes_differ_ten_thousandfold(spark, monkeypatch, most_edges):
    monkeypatch.setattr(cover, "MOST_EDGES", most_edges)
    monkeypatch.setattr(cover.cover, "__defaults__", ("rings", most_edges))
    shapes = [("wide", [star(0, 0, 5000.0, 900)]), ("town", [star(100, 50, 40.0, 300), star(100, 50, 10.0, 60)[::-1]])]
    shapes += [(f"lot{k}", [star(90 + k, 45 + 0.3 * k, 0.5, 9)]) for k in range(20)]
    shapes.append(("far", [[(6000.0, 1.0), (6001.0, 1.0), (6001.0, 2.0), (6000.0, 1.0)]]))
    rng = np.random.default_rng(4)
    near = rng.uniform((80, 35), (120, 70), (600, 2))
    wide = rng.uniform(-5500, 6500, (600, 2))
    points = [(i, float(a), float(b)) for i, (a, b) in enumerate(np.r_[near, wide])]
    corners = [c for _, rings in shapes for c in rings[0][:6]]
    points += [(5000 + i, *c) for i, c in enumerate(corners)]
    assert found(spark, shapes, points) == expected(shapes, points)


def test_the_cover_is_bounded_by_the_edges(spark):
    """Ten thousand times the area makes no more cells, and inner cells are as coarse as they fit."""
    shapes = [("a", [star(0, 0, 1.0, 2000, 0.01)]), ("b", [star(20000, 0, 10000.0, 2000, 0.01)]), ("box", [SQUARE])]
    cells = cover.cover(layer(spark, shapes), ["name"]).cells
    n = {r["name"]: (r["n"], r["e"], r["levels"]) for r in cells.groupBy("name").agg(
        F.count("*").alias("n"), F.max(F.size("_edges")).alias("e"), F.count_distinct(F.when(F.size("_edges") == 0, F.col("_level"))).alias("levels")).collect()}
    for name in ("a", "b"):
        rows, most, levels = n[name]
        assert rows < 2000 and most <= cover.MOST_EDGES and levels >= 2
    assert n["box"][0] <= 4


def test_many_edges_at_one_corner_do_not_divide_for_ever(spark):
    fan = [p for k in range(40) for p in ((0.0, 0.0), (math.cos(k / 30), math.sin(k / 30)), (math.cos(k / 30 + 0.01), math.sin(k / 30 + 0.01)))]
    shapes = [("fan", [[*fan, fan[0]]])]
    rng = np.random.default_rng(2)
    points = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(-0.1, 1.1, (300, 2)))] + [(999, 0.0, 0.0)]
    assert found(spark, shapes, points) == expected(shapes, points)


def test_nothing_to_search(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0)], "id int, x double, y double")
    none = spark.createDataFrame([], f"name string, rings {RINGS_TYPE}")
    assert cover.locate(df, "x", "y", none, ["name"]).collect() == [(1, 0.0, 0.0, None)]
    assert cover.locate(df.limit(0), "x", "y", layer(spark, [("e", [ELL])]), ["name"]).count() == 0


def test_repeated_points_stay_apart(spark):
    df = spark.createDataFrame([(1, 0.5, 0.5)] * 3 + [(1, 9.0, 9.0)] * 2, "id int, x double, y double")
    got = cover.locate(df, "x", "y", layer(spark, [("e", [ELL]), ("s", [SQUARE])]), ["name"]).groupBy("name").count().collect()
    assert {r["name"]: r["count"] for r in got} == {"e": 3, "s": 3, None: 2}
