"""Geometry on literal shapes, and smoothed indices against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from diurnal.functions.shapes import CONUS_ALBERS, RINGS_TYPE, albers, area, centroid, edges
from diurnal.operators import segregation, spatial

SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
HOLE = [(1.0, 1.0), (1.0, 3.0), (3.0, 3.0), (3.0, 1.0), (1.0, 1.0)]
ELL = [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (1.0, 1.0), (1.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
SMALL = [(3.0, 3.0), (5.0, 3.0), (5.0, 5.0), (3.0, 5.0), (3.0, 3.0)]


def layer(spark, shapes):
    return spark.createDataFrame(shapes, f"name string, rings {RINGS_TYPE}")


@pytest.mark.parametrize("small", [True, False])
def test_points_on_edges_in_holes_and_overlaps(spark, small, request):
    if not small:
        request.getfixturevalue("no_broadcast")
    shapes = layer(spark, [("ring", [SQUARE, HOLE]), ("small", [SMALL])])
    pts = {"solid": (0.5, 0.5), "hole": (2.0, 2.0), "edge": (4.0, 2.0), "corner": (0.0, 0.0), "both": (3.5, 3.5), "out": (9.0, 9.0)}
    df = spark.createDataFrame([(k, *v) for k, v in pts.items()], "id string, x double, y double")
    got = spatial.points_in_polygons(df, "x", "y", shapes, ["name"], 0.7, "id")
    found = {}
    for r in got.collect():
        found.setdefault(r["id"], set()).add(r["name"])
    assert found == {
        "solid": {"ring"}, "hole": {None}, "edge": {"ring"}, "corner": {"ring"}, "both": {"ring", "small"}, "out": {None}
    }


def test_centroids(spark):
    df = layer(spark, [("ell", [ELL]), ("ring", [SQUARE, HOLE])])
    got = {r["name"]: (r["c"]["x"], r["c"]["y"]) for r in df.select("name", centroid(edges("rings")).alias("c")).collect()}
    assert got["ell"] == pytest.approx((5 / 6, 5 / 6)) and got["ring"] == pytest.approx((2.0, 2.0))


def test_areas(spark):
    df = layer(spark, [("ell", [ELL]), ("ring", [SQUARE, HOLE])])
    assert {r["name"]: r["a"] for r in df.select("name", area(edges("rings")).alias("a")).collect()} == {"ell": 3.0, "ring": 12.0}


def test_dissolve_drops_shared_edges(spark):
    a = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    b = [(1.0, 0.0), (2.0, 0.0), (2.0, 1.0), (1.0, 1.0), (1.0, 0.0)]
    got = spatial.dissolve(layer(spark, [("g", [a]), ("g", [b])]), ["name"])
    assert got.count() == 6
    assert got.filter("x1 = 1 and x2 = 1").count() == 0


def test_dissolve_deals_edges_to_tasks_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(spatial, "TASK_EDGES", 50)
    square = lambda x: [(x, 0.0), (x + 1, 0.0), (x + 1, 1.0), (x, 1.0), (x, 0.0)]
    shapes = layer(spark, [("g", [square(float(x))]) for x in range(100)]).coalesce(1)
    got = spatial.dissolve(shapes, ["name"])
    assert got.count() == 202 and got.rdd.getNumPartitions() == 8
    # edges are dealt out before any task counts them
    plan = spatial.dissolve(shapes, ["name"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("HashAggregate") < plan.rindex("HashAggregate") < plan.index("Exchange hashpartitioning")


def test_albers_published_example(spark):
    """Snyder (1987, p. 292): Clarke 1866, 35 N 75 W, parallels 29.5 and 45.5, origin 23 N 96 W."""
    at = albers(F.lit(-75.0), F.lit(35.0), 29.5, 45.5, 23.0, -96.0, axis=6378206.4, e2=0.00676866)
    p = spark.range(1).select(at.alias("p")).first()["p"]
    assert (p["x"], p["y"]) == pytest.approx((1885472.7, 1535925.0), abs=0.5)
    o = spark.range(1).select(albers(F.lit(-96.0), F.lit(37.5), **CONUS_ALBERS).alias("p")).first()["p"]
    assert (o["x"], o["y"]) == pytest.approx((0.0, 0.0), abs=1e-6)


@pytest.fixture(scope="module")
def town(spark):
    rng = np.random.default_rng(5)
    n = 300
    xy = np.round(rng.uniform(0, 3, (n, 2)), 3)
    xy[:100] = (1.111, 1.222)
    c = rng.integers(0, 30, (n, 5)).astype(float)
    cols = [f"res_{g}_est" for g in ("nhw", "nhb", "h", "nha", "nho")]
    rows = [(1 if i < 250 else 2, *map(float, xy[i]), *map(float, c[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "m int, x double, y double, " + ", ".join(f"{k} double" for k in cols))
    return xy, c, df


def brute(xy, c, cell, radius, beta):
    k = np.floor(xy / cell)
    d = np.sqrt(((k[:, None] - k[None]) ** 2).sum(2)) * cell
    phi = np.where(d <= radius, np.exp(-beta * d), 0)
    m = np.c_[c[:, 3], c[:, 1], c[:, 2], c[:, 0]]
    ent = lambda p: -np.where(p > 0, p * np.log(np.where(p > 0, p, 1)), 0).sum(-1)
    env = phi @ m
    share = env / env.sum(1, keepdims=True)
    t = m.sum(1)
    h = 1 - (t * ent(share)).sum() / (t.sum() * ent(m.sum(0) / t.sum()))
    x, y = c[:, 1:].sum(1), c[:, 0]
    ex, ey = phi @ x, phi @ y
    return h, (x / x.sum() * ex / (ex + ey)).sum()


def test_smoothed_indices(town):
    xy, c, df = town
    got = {r["m"]: r for r in spatial.spatial_indices(df, ["m"], "x", "y", 0.2, 0.9, 2.0).collect()}
    for m, s in [(1, slice(0, 250)), (2, slice(250, 300))]:
        h, iso = brute(xy[s], c[s], 0.2, 0.9, 2.0)
        assert got[m]["spat_multi_theil_nhood"] == pytest.approx(h)
        assert got[m]["spat_iso_nhood"] == pytest.approx(iso)


def test_steep_kernel_gives_plain_indices_of_the_raster(town):
    _, _, df = town
    far = spatial.spatial_indices(df, ["m"], "x", "y", 0.001, 0.002, 1e6).collect()
    folded = df.groupBy("m", "x", "y").agg(*[F.sum(c).alias(c) for c in df.columns[3:]])
    plain = folded.groupBy("m").agg(
        segregation.information_index([f"res_{g}_est" for g in ("nha", "nhb", "h", "nhw")]).alias("h")
    )
    want = {r["m"]: r["h"] for r in plain.collect()}
    assert {r["m"]: r["spat_multi_theil_nhood"] for r in far} == pytest.approx(want)


def test_a_raster_may_be_as_fine_as_it_likes(spark):
    """A reach of hundreds of cells: sums over pairs of places, since each has a cell of its own."""
    rng = np.random.default_rng(8)
    xy, c = (rng.integers(0, 900, (12, 2)) + 0.5) / 1000, rng.integers(1, 30, (12, 5)).astype(float)
    cols = [f"res_{g}_est" for g in ("nhw", "nhb", "h", "nha", "nho")]
    rows = [(1, *map(float, xy[i]), *map(float, c[i])) for i in range(12)]
    df = spark.createDataFrame(rows, "m int, x double, y double, " + ", ".join(f"{k} double" for k in cols))
    got = spatial.spatial_indices(df, ["m"], "x", "y", 0.001, 0.3, 2.0).first()
    h, iso = brute(xy, c, 0.001, 0.3, 2.0)
    assert (got["spat_multi_theil_nhood"], got["spat_iso_nhood"]) == pytest.approx((h, iso))


def test_fine_cells_are_not_broadcast_and_carry_few_edges(spark):
    """Two polygons on a fine grid are many cells: measured, not estimated."""
    shapes = layer(spark, [("ring", [SQUARE, HOLE]), ("small", [SMALL])])
    rng = np.random.default_rng(9)
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(-1, 6, (500, 2)))]
    df = spark.createDataFrame(pts, "id int, x double, y double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        found = spatial.points_in_polygons(df, "x", "y", shapes, ["name"], 0.01, "id")
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
        got = {(r["id"], r["name"]) for r in found.filter("name is not null").collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    ring = {i for i, x, y in pts if 0 <= x <= 4 and 0 <= y <= 4 and not (1 < x < 3 and 1 < y < 3)}
    small = {i for i, x, y in pts if 3 <= x <= 5 and 3 <= y <= 5}
    assert got == {(i, "ring") for i in ring} | {(i, "small") for i in small}


def test_density_integrates_to_one(spark):
    df = spark.createDataFrame([("a", float(v)) for v in np.random.default_rng(0).normal(size=800)], "k string, v double")
    d = spatial.density_profile(df, ["k"], "v", points=128).orderBy("i").toPandas()
    assert np.trapezoid(d["density"], d["grid_x"]) == pytest.approx(1.0, abs=0.01)
