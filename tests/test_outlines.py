"""Outlines as rings: T-junctions, holes, touching corners, and areas that add up."""

import random

import pytest
from pyspark.sql import functions as F

from diurnal.functions.shapes import area, edges
from diurnal.operators import outlines

from test_spatial import HOLE, SQUARE, layer


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def found(spark, shapes, tolerance=1e-9):
    out = []
    for r in outlines.outlines(layer(spark, shapes), ["name"], tolerance).collect():
        out.append((r["name"], [tuple(p) for p in r["points"]], r["area"], r["hole"]))
    return sorted(out)


def signed(points):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:])) / 2


def test_t_junctions_cancel(spark):
    """A wide box under two narrow ones: no corner of the upper ones is one of the lower."""
    shapes = [("g", [box(0, 0, 4, 1)]), ("g", [box(0, 1, 1.5, 2)[::-1]]), ("g", [box(1.5, 1, 4, 2)]), ("h", [box(4, 0, 5, 1)])]
    shapes = [(n, [[(float(x), float(y)) for x, y in r] for r in rings]) for n, rings in shapes]
    (g, h) = found(spark, shapes)
    assert g[2:] == (8.0, False) and h[2:] == (1.0, False)
    assert g[1][0] == g[1][-1] == (0.0, 0.0) and signed(g[1]) == 8.0
    assert (1.5, 1.0) not in g[1]


def test_holes_run_the_other_way(spark):
    ring = [((float(x), float(y), float(x + 1), float(y + 1))) for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    got = found(spark, [("g", [box(*b)]) for b in ring] + [("s", [SQUARE, HOLE])])
    assert [(n, a, hole) for n, _, a, hole in got] == [("g", 9.0, False), ("g", 1.0, True), ("s", 16.0, False), ("s", 4.0, True)]
    assert all((signed(p) < 0) == hole for _, p, _, hole in got)


def test_pieces_that_touch_at_a_corner_are_rings_of_their_own(spark):
    got = found(spark, [("g", [box(0.0, 0.0, 1.0, 1.0)]), ("g", [box(1.0, 1.0, 2.0, 2.0)])])
    assert [(len(p), a) for _, p, a, _ in got] == [(5, 1.0), (5, 1.0)]
    # two holes that meet at a corner
    left = [(x, y) for x in range(4) for y in range(4) if (x, y) not in ((1, 1), (2, 2))]
    got = found(spark, [("g", [box(float(x), float(y), x + 1.0, y + 1.0)]) for x, y in left])
    assert sorted((a, hole) for _, _, a, hole in got) == [(1.0, True), (1.0, True), (16.0, False)]


@pytest.mark.parametrize("seed", [1, 2])
def test_areas_are_the_sum_of_the_parts(spark, seed, request):
    """A square cut at random again and again; three groups of parts, some cut askew."""
    if seed == 2:
        request.getfixturevalue("no_broadcast")
    rng = random.Random(seed)
    parts = [box(0.0, 0.0, 64.0, 64.0)[:-1]]
    for _ in range(120):
        k = max(range(len(parts)), key=lambda i: rng.random() * abs(signed([*parts[i], parts[i][0]])))
        p = parts.pop(k)
        n = len(p)
        i, j = rng.randrange(n), rng.randrange(1, n - 1) if n > 3 else 1
        i, j = 0, n // 2
        cut = lambda a, b: (a[0] + (b[0] - a[0]) / 2, a[1] + (b[1] - a[1]) / 2)
        a, b = cut(p[i], p[i + 1]), cut(p[j], p[(j + 1) % n])
        parts += [[a, *p[i + 1 : j + 1], b], [b, *p[j + 1 :], *p[: i + 1], a]]
    shapes = []
    for p in parts:
        closed = [*p, p[0]]
        shapes.append((f"g{rng.randrange(3)}", [closed if rng.random() < 0.5 else closed[::-1]]))
    df = layer(spark, shapes)
    got = outlines.outlines(df, ["name"], 1e-9)
    whole = {r["name"]: r["a"] for r in got.groupBy("name").agg(F.sum(F.when(F.col("hole"), -F.col("area")).otherwise(F.col("area"))).alias("a")).collect()}
    want = {r["name"]: r["a"] for r in df.groupBy("name").agg(F.sum(area(edges("rings"))).alias("a")).collect()}
    assert whole == pytest.approx(want)
    assert got.filter(F.element_at("points", 1) != F.element_at("points", -1)).count() == 0
    everything = outlines.outlines(df.withColumn("name", F.lit("all")), ["name"], 1e-9).collect()
    assert len(everything) == 1 and everything[0]["area"] == pytest.approx(4096.0)


def test_long_rings_take_few_rounds(spark, monkeypatch):
    """A comb of 600 teeth is one ring; rounds grow with the digits of its length."""
    rounds = []
    jumped = outlines._jumped
    monkeypatch.setattr(outlines, "_jumped", lambda *a: rounds.append(1) or jumped(*a))
    teeth = [(0.0, 0.0)] + [p for k in range(600, 0, -1) for p in ((k + 0.0, 0.0), (k + 0.0, 1.0), (k - 0.5, 1.0), (k - 0.5, 0.2))][:-1] + [(0.5, -5.0), (0.0, -5.0)]
    comb = [("g", [[*[(0.0, -5.0), (601.0, -5.0), (601.0, 0.0)], *teeth[1:-2], (0.0, 0.2), (0.0, -5.0)]])]
    got = found(spark, comb)
    assert len(got) == 1 and len(got[0][1]) > 2000 and len(rounds) <= 2 * 13
    assert got[0][2] == pytest.approx(abs(signed(comb[0][1][0])))


def test_no_polygons(spark):
    assert outlines.outlines(layer(spark, []), ["name"], 1e-9).collect() == []


def test_no_table_of_outlines_goes_through_the_driver(spark, monkeypatch):
    """Written tables compress well: by the size of their files Catalyst would broadcast them however long they are."""
    plans = []
    settle = outlines.settle

    def spied(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settle(df)

    monkeypatch.setattr(outlines, "settle", spied)
    shapes = [("g", [box(float(x), 0.0, x + 1.0, 1.0)]) for x in range(40)] + [("g", [box(50.0, 0.0, 51.0, 1.0)]), ("g", [box(51.0, 1.0, 52.0, 2.0)])]
    assert sorted(a for _, _, a, _ in found(spark, shapes)) == [1.0, 1.0, 40.0]
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
