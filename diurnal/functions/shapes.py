"""Geometry as Column expressions over ``rings`` (array of closed rings of points)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import ColumnLike, as_col

RINGS_TYPE = "array<array<struct<x:double,y:double>>>"
EDGES_TYPE = "array<struct<x1:double,y1:double,x2:double,y2:double>>"

# GRS 1980 ellipsoid (semi-major axis in metres, squared eccentricity) and the
# usual Albers parameters for the contiguous United States, in degrees.
GRS80_AXIS, GRS80_E2 = 6378137.0, 0.006694380022903416
CONUS_ALBERS = {"lat1": 29.5, "lat2": 45.5, "lat0": 37.5, "lon0": -96.0}


def point(x: ColumnLike, y: ColumnLike) -> Column:
    return F.struct(as_col(x).cast("double").alias("x"), as_col(y).cast("double").alias("y"))


def ring(*points: tuple[ColumnLike, ColumnLike]) -> Column:
    """A closed ring through the given corners."""
    corners = [point(x, y) for x, y in points]
    return F.array(*corners, corners[0])


def edges(rings: ColumnLike) -> Column:
    """All edges of all rings as structs (x1, y1, x2, y2)."""

    def of_ring(r: Column) -> Column:
        m = F.size(r) - 1
        return F.zip_with(
            F.slice(r, F.lit(1), m),
            F.slice(r, F.lit(2), m),
            lambda p, q: F.struct(
                p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")
            ),
        )

    return F.flatten(F.transform(as_col(rings), of_ring)).cast(EDGES_TYPE)


def _over_edges(edge_list: Column, term) -> Column:
    return F.aggregate(edge_list, F.lit(0.0), lambda acc, e: acc + term(e))


def _cross(e: Column) -> Column:
    return e["x1"] * e["y2"] - e["x2"] * e["y1"]


def area(edge_list: ColumnLike) -> Column:
    """Area inside the rings; holes count negatively by their opposite direction."""
    return F.abs(_over_edges(as_col(edge_list), _cross)) / 2


def centroid(edge_list: ColumnLike) -> Column:
    """Area centroid as a point; holes count negatively by their opposite direction."""
    e = as_col(edge_list)
    area2 = _over_edges(e, _cross)
    mean = lambda a, b: _over_edges(e, lambda s: (s[a] + s[b]) * _cross(s)) / (3 * area2)
    return point(mean("x1", "x2"), mean("y1", "y2"))


def bounding_box(rings: ColumnLike) -> Column:
    points = F.flatten(as_col(rings))
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("xmin"),
        F.array_max(xs).alias("xmax"),
        F.array_min(ys).alias("ymin"),
        F.array_max(ys).alias("ymax"),
    )


def covers(edge_list: ColumnLike, x: ColumnLike, y: ColumnLike) -> Column:
    """Whether a point lies in the polygon or on its boundary (even-odd rule)."""
    e, px, py = as_col(edge_list), as_col(x), as_col(y)
    crossing = lambda s: ((s["y1"] > py) != (s["y2"] > py)) & (
        px
        < (s["x2"] - s["x1"]) * F.try_divide(py - s["y1"], s["y2"] - s["y1"]) + s["x1"]
    )
    on_edge = lambda s: (
        ((s["x2"] - s["x1"]) * (py - s["y1"]) == (s["y2"] - s["y1"]) * (px - s["x1"]))
        & px.between(F.least(s["x1"], s["x2"]), F.greatest(s["x1"], s["x2"]))
        & py.between(F.least(s["y1"], s["y2"]), F.greatest(s["y1"], s["y2"]))
    )
    return (F.size(F.filter(e, crossing)) % 2 == 1) | F.exists(e, on_edge)


def albers(
    lon: ColumnLike,
    lat: ColumnLike,
    lat1: float,
    lat2: float,
    lat0: float,
    lon0: float,
    axis: float = GRS80_AXIS,
    e2: float = GRS80_E2,
) -> Column:
    """Albers equal-area conic projection of degrees to a point in metres (Snyder 1987)."""
    ecc = math.sqrt(e2)

    def m(phi: float) -> float:
        return math.cos(phi) / math.sqrt(1 - e2 * math.sin(phi) ** 2)

    def q_of(s, log):
        return (1 - e2) * (
            s / (1 - e2 * s * s) - (1 / (2 * ecc)) * log((1 - ecc * s) / (1 + ecc * s))
        )

    p1, p2, p0 = (math.radians(v) for v in (lat1, lat2, lat0))
    q0, q1, q2 = (q_of(math.sin(p), math.log) for p in (p0, p1, p2))
    n = (m(p1) ** 2 - m(p2) ** 2) / (q2 - q1)
    c = m(p1) ** 2 + n * q1
    rho0 = axis * math.sqrt(c - n * q0) / n
    q = q_of(F.sin(F.radians(as_col(lat))), F.ln)
    rho = axis * F.sqrt(c - n * q) / n
    theta = n * F.radians(as_col(lon) - lon0)
    return point(rho * F.sin(theta), rho0 - rho * F.cos(theta))


def distance(x1: ColumnLike, y1: ColumnLike, x2: ColumnLike, y2: ColumnLike) -> Column:
    dx, dy = as_col(x1) - as_col(x2), as_col(y1) - as_col(y2)
    return F.sqrt(dx * dx + dy * dy)
