"""Spatial joins, outlines and spatially smoothed segregation."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.composition import entropy, total
from ..functions.nulls import as_col, ratio
from ..functions.shapes import bounding_box, covers, edges
from ..session import settle
from . import kernels
from .joins import attach, natural_join
from .order import quantiles


def _cell_span(low: Column, high: Column, size: float) -> Column:
    return F.explode(
        F.sequence(F.floor(low / size).cast("bigint"), F.floor(high / size).cast("bigint"))
    )


def points_in_polygons(
    points: DataFrame,
    x: str,
    y: str,
    polygons: DataFrame,
    attributes: Sequence[str],
    cell: float,
    point_id: str,
    rings: str = "rings",
) -> DataFrame:
    """Left join of points to the polygons that contain them, boundaries included.

    Polygons are listed under the grid cells they touch and points under their one
    cell, which makes the search an equi-join; the exact test is part of the join condition. A
    cell that no edge touches lies wholly inside a polygon (no test is needed) or outside (it is
    not listed); the others carry only the edges that meet their row of the grid, which
    decide how often a ray along the row crosses the outline. A point is in one cell, so this is one
    left join and every point comes out once per hit, or once without. Points of a crowded
    cell are spread by id.
    """
    low, high = F.col("_cy") * cell, (F.col("_cy") + 1) * cell
    in_row = F.filter(
        "_edges", lambda e: (F.greatest(e["y1"], e["y2"]) >= low) & (F.least(e["y1"], e["y2"]) <= high)
    )
    rows = (
        polygons.withColumn("_box", bounding_box(rings))
        .select(
            *attributes,
            edges(rings).alias("_edges"),
            "_box",
            _cell_span(F.col("_box.ymin"), F.col("_box.ymax"), cell).alias("_cy"),
        )
        .select(*attributes, "_box", "_cy", in_row.alias("_edges"))
    )
    left, right = F.col("_cx") * cell, (F.col("_cx") + 1) * cell
    touched = F.exists(
        "_edges", lambda e: (F.greatest(e["x1"], e["x2"]) >= left) & (F.least(e["x1"], e["x2"]) <= right)
    )
    middle = covers("_edges", (F.col("_cx") + 0.5) * cell, (F.col("_cy") + 0.5) * cell)
    shapes = (
        rows.select("*", _cell_span(F.col("_box.xmin"), F.col("_box.xmax"), cell).alias("_cx"))
        .withColumn("_whole", ~touched)
        .filter(~F.col("_whole") | middle)
        .select(
            *attributes, "_cx", "_cy", "_whole", F.when(~F.col("_whole"), F.col("_edges")).alias("_edges")
        )
    )
    located = points.withColumns(
        {
            "_cx": F.floor(F.col(x) / cell).cast("bigint"),
            "_cy": F.floor(F.col(y) / cell).cast("bigint"),
        }
    )
    inside = F.col("_whole") | covers("_edges", x, y)
    return attach(located, shapes, ["_cx", "_cy"], [point_id], "left", inside).drop(
        "_cx", "_cy", "_edges", "_whole"
    )


#: Edges that a task of ``dissolve`` counts, about.
TASK_EDGES = 500_000


def dissolve(polygons: DataFrame, group: Sequence[str], rings: str = "rings") -> DataFrame:
    """Outline of each group as boundary segments: the edges used by one polygon only.

    Exact for layers whose neighbours share vertices. Edges are dealt to as many tasks as their number
    needs before any are counted, since a small file of polygons is one task whose table of edges would hold
    them all; no polygon is ever assembled in one place.
    """
    edge_count = polygons.agg(F.sum(F.size(edges(rings)).cast("long"))).first()[0] or 0
    parts = max(1, -(-edge_count // TASK_EDGES))
    e = polygons.select(*group, F.explode(edges(rings)).alias("e"))
    first = F.struct(F.col("e.x1").alias("x"), F.col("e.y1").alias("y"))
    second = F.struct(F.col("e.x2").alias("x"), F.col("e.y2").alias("y"))
    return (
        e.select(*group, F.least(first, second).alias("p"), F.greatest(first, second).alias("q"))
        .repartition(parts, *group, "p", "q")
        .groupBy(*group, "p", "q")
        .agg(F.count(F.lit(1)).alias("_uses"))
        .filter(F.col("_uses") == 1)
        .select(
            *group,
            F.col("p.x").alias("x1"),
            F.col("p.y").alias("y1"),
            F.col("q.x").alias("x2"),
            F.col("q.y").alias("y2"),
        )
    )


def population_surface(
    units: DataFrame, keys: Sequence[str], x: str, y: str, counts: Mapping[str, Column | str], cell: float
) -> DataFrame:
    """Counts per raster cell. Areas at one place fold into one row, however many they are."""
    return (
        units.withColumns(
            {
                "cx": F.floor(F.col(x) / cell).cast("bigint"),
                "cy": F.floor(F.col(y) / cell).cast("bigint"),
                **{f"_in_{n}": as_col(c) for n, c in counts.items()},
            }
        )
        .groupBy(*keys, "cx", "cy")
        .agg(*[F.sum(f"_in_{n}").alias(n) for n in counts])
    )


def _spread_out(
    surface: DataFrame, keys: Sequence[str], cell: float, radius: float, beta: float
) -> DataFrame:
    """Each raster cell repeated for the cells within the radius, with the kernel weight.

    Columns added: ``to_cx``, ``to_cy``, ``dist``, ``phi``. The raster is grouped into blocks as wide
    as the radius. A cell goes to those of the nine blocks around it that are occupied, and only
    there to the cells within the radius: the number of copies depends on radius / cell, and empty land gets none.
    """
    reach = math.floor(radius / cell)
    side = max(reach, 1)
    block = lambda c: F.floor(F.col(c) / side).cast("bigint")
    step = F.explode(F.sequence(F.lit(-1).cast("bigint"), F.lit(1).cast("bigint")))
    occupied = surface.select(*keys, block("cx").alias("_bx"), block("cy").alias("_by")).distinct()
    near = surface.withColumn("_bx", step).withColumn("_by", step)
    near = near.withColumns({"_bx": F.col("_bx") + block("cx"), "_by": F.col("_by") + block("cy")})
    near = natural_join(near, occupied, "left_semi", [*keys, "_bx", "_by"])

    def inside(c: str, b: str) -> tuple[Column, Column]:
        return F.greatest(F.col(c) - reach, F.col(b) * side), F.least(F.col(c) + reach, F.col(b) * side + side - 1)

    (x0, x1), (y0, y1) = inside("cx", "_bx"), inside("cy", "_by")
    dx, dy = F.col("to_cx") - F.col("cx"), F.col("to_cy") - F.col("cy")
    far = F.sqrt((dx * dx + dy * dy).cast("double")) * cell
    return (
        near.filter((x0 <= x1) & (y0 <= y1))
        .withColumn("to_cx", F.explode(F.sequence(x0, x1)))
        .withColumn("to_cy", F.explode(F.sequence(y0, y1)))
        .withColumn("dist", far)
        .filter(F.col("dist") <= radius)
        .withColumn("phi", F.exp(-beta * F.col("dist")))
        .drop("_bx", "_by")
    )


def kernel_neighbours(
    surface: DataFrame, keys: Sequence[str], cell: float, radius: float, beta: float
) -> DataFrame:
    """Occupied cells within the radius of each occupied cell of a group, with distance and weight."""
    out = _spread_out(surface.select(*keys, "cx", "cy"), keys, cell, radius, beta)
    occupied = surface.select(*keys, F.col("cx").alias("to_cx"), F.col("cy").alias("to_cy"))
    return natural_join(out, occupied, "left_semi", [*keys, "to_cx", "to_cy"])


def local_environment(
    surface: DataFrame,
    keys: Sequence[str],
    counts: Sequence[str],
    cell: float,
    radius: float,
    beta: float,
) -> DataFrame:
    """Kernel-weighted counts around each occupied raster cell, as ``env_*`` columns.

    Every cell sends its weighted counts to the cells in reach and arrivals are summed with
    partial aggregation. No pair of areas is formed, and a metro holding a third of the areas
    is spread over as many tasks as it has cells.
    """
    sent = _spread_out(surface, keys, cell, radius, beta).select(
        *keys,
        F.col("to_cx").alias("cx"),
        F.col("to_cy").alias("cy"),
        *[(F.col(c) * F.col("phi")).alias(f"env_{c}") for c in counts],
    )
    env = sent.groupBy(*keys, "cx", "cy").agg(*[F.sum(f"env_{c}").alias(f"env_{c}") for c in counts])
    return natural_join(surface, env, "left", [*keys, "cx", "cy"])


def spatial_information_index(counts: Sequence[str]) -> Column:
    """1 - sum(t_p E~_p) / (T E) over cells with their local environments."""
    here = total(counts)
    around = total([f"env_{c}" for c in counts])
    local = here * entropy([F.coalesce(ratio(f"env_{c}", around), F.lit(0.0)) for c in counts])
    whole = F.sum(here)
    overall = entropy([ratio(F.sum(c), whole) for c in counts])
    return 1 - F.try_divide(F.sum(local), F.nullif(whole * overall, F.lit(0.0)))


def spatial_isolation(minority: str, majority: str) -> Column:
    """sum (x_p / X) * (minority share of the environment of p)."""
    around = F.col(f"env_{minority}") + F.col(f"env_{majority}")
    met = F.col(minority) * F.coalesce(ratio(f"env_{minority}", around), F.lit(0.0))
    return F.try_divide(F.sum(met), F.sum(minority))


def spatial_indices(
    units: DataFrame,
    keys: Sequence[str],
    x: str,
    y: str,
    cell: float,
    radius: float,
    beta: float,
    prefix: str = "res",
    suffix: str = "nhood",
) -> DataFrame:
    """Spatially smoothed information index and isolation of four minorities versus white, on a raster."""
    counts = _index_counts(prefix)
    surface = population_surface(units, keys, x, y, counts, cell)
    return _indices(local_environment(surface, keys, list(counts), cell, radius, beta), keys, suffix)


def area_indices(
    units: DataFrame,
    keys: Sequence[str],
    x: str,
    y: str,
    beta: float,
    radius: float | None = None,
    error: float = 1e-6,
    prefix: str = "res",
    suffix: str = "nhood",
) -> DataFrame:
    """The same from distances between the areas themselves, without a raster.

    Exact within ``radius``. Without one every area counts, and far ones are taken together so
    that no environment is off by more than ``error`` times the group's total.
    """
    counts = _index_counts(prefix)
    at = kernels.places(units, keys, x, y, counts)
    if radius is None:
        env = kernels.sums_of_all(at, keys, list(counts), beta, error)
    else:
        env = kernels.sums_within(at, keys, list(counts), radius, beta)
    return _indices(env, keys, suffix)


def _index_counts(prefix: str) -> dict[str, Column]:
    col = lambda g: F.col(f"{prefix}_{g}_est")
    counts = {g: col(g) for g in ("nha", "nhb", "h", "nhw")}
    return counts | {"minority": total([col(g) for g in ("nhb", "nha", "h", "nho")])}


def _indices(env: DataFrame, keys: Sequence[str], suffix: str) -> DataFrame:
    return env.groupBy(*keys).agg(
        spatial_information_index(["nha", "nhb", "h", "nhw"]).alias(f"spat_multi_theil_{suffix}"),
        spatial_isolation("minority", "nhw").alias(f"spat_iso_{suffix}"),
        *[
            spatial_isolation(g, "nhw").alias(f"spat_iso_{g}_{suffix}")
            for g in ("nhb", "nha", "h")
        ],
    )


#: Moments of a box, and boxes to either side of a grid point that count: together below 1e-11 of the exact sum's scale.
MOMENTS, REACH = 16, 9


def _gauss_sum(moments: Column, u: Column) -> Column:
    """``sum m_k h_k(u)`` over Hermite functions, by their recurrence h' = 2 u h - 2 k h_before."""
    start = F.struct(
        F.lit(0.0).alias("before"), F.exp(-u * u).alias("h"), F.lit(0.0).alias("k"), F.lit(0.0).alias("sum")
    )
    step = lambda a, m: F.struct(
        a["h"].alias("before"),
        (2 * u * a["h"] - 2 * a["k"] * a["before"]).alias("h"),
        (a["k"] + 1).alias("k"),
        (a["sum"] + m * a["h"]).alias("sum"),
    )
    return F.aggregate(moments, start, step, lambda a: a["sum"])


def density_profile(df: DataFrame, keys: Sequence[str], value: str, points: int = 64) -> DataFrame:
    """Gaussian kernel density of a measure on a grid, per group, by a fast Gauss transform.

    The sum over all rows is evaluated through boxes as wide as the bandwidth: rows are folded to the
    moments of their box with partial aggregation, and a grid point adds the Hermite expansions of the boxes
    around it. Its error is below 1e-11 of the density of all rows at one point, so the result is the exact
    sum for practical purposes, and a group contributes one row per occupied box, whatever its size.
    Bandwidth 0.9 min(sd, IQR / 1.34) n^(-1/5); grid from min - 3 bw to max + 3 bw. Where the bandwidth
    is 0 or unknown the density is NULL.
    """
    known = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    spans = known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_all"),
        F.stddev_samp("_v").alias("sd"),
        F.min("_v").alias("low"),
        F.max("_v").alias("high"),
    )
    quart = quantiles(known, keys, "_v", {"q1": 0.25, "q3": 0.75})
    stats = settle(
        natural_join(spans, quart, "left", keys).withColumn(
            "bw", 0.9 * F.least("sd", (F.col("q3") - F.col("q1")) / 1.34) * F.pow("n_all", F.lit(-0.2))
        )
    )
    scaled = attach(known, stats.select(*keys, "low", "bw"), keys, ["_v"], "inner")
    at = F.try_divide(F.col("_v") - F.col("low"), F.col("bw"))
    off = (F.col("_at") - F.col("_box") - 0.5) / math.sqrt(2)
    boxed = scaled.withColumn("_at", at).withColumn("_box", F.floor("_at").cast("bigint")).withColumn("_off", off)
    moments = boxed.groupBy(*keys, "_box").agg(
        F.array(*[F.sum(F.pow("_off", F.lit(k))) / math.factorial(k) for k in range(MOMENTS)]).alias("_moments")
    )
    grid = stats.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).withColumn(
        "grid_x",
        F.col("low") - 3 * F.col("bw")
        + F.col("i") * (F.col("high") - F.col("low") + 6 * F.col("bw")) / (points - 1),
    )
    place = F.try_divide(F.col("grid_x") - F.col("low"), F.col("bw"))
    around = F.sequence(F.lit(-REACH).cast("bigint"), F.lit(REACH).cast("bigint"))
    near = grid.withColumn("_at", place).withColumn("_step", F.explode(around))
    near = near.withColumn("_box", F.floor("_at").cast("bigint") + F.col("_step"))
    u = (F.col("_at") - F.col("_box") - 0.5) / math.sqrt(2)
    scale = F.max("n_all") * F.max("bw") * math.sqrt(2 * math.pi)
    part = natural_join(near, moments, "left", [*keys, "_box"]).withColumn("_part", _gauss_sum(F.col("_moments"), u))
    whole = F.when(F.max("bw").isNotNull(), F.coalesce(F.sum("_part"), F.lit(0.0)))
    return part.groupBy(*keys, "i").agg(F.max("grid_x").alias("grid_x"), F.try_divide(whole, scale).alias("density"))
