"""Point-in-polygon search by an adaptive quadtree cover of every polygon.

A polygon starts with the few cells about its own size. A cell that holds many of its edges is
divided, one without edges is inside or outside as a whole and stays as coarse as it is, so large polygons
and small ones, dense outlines and plain ones, get cells that fit them. The number of cells is bounded by
the edges of the outlines, not by areas over a cell size.

A cell keeps only the edges in its reach, and the parity of the outline at its lower right corner. For a
point in the cell the even-odd rule then needs the ray up to the cell's right side, and the crossings of that side
below the ray; both are edges of the cell. Points on an outline count as inside. Codes of cells are
prefixes of each other (a cell's code shifted by two bits a level), so a search is an equi-join on (level, code).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shapes import bounding_box, edges
from ..session import measured, settle
from .joins import attach

#: Edges of a cell that is not divided further, levels a division goes down, and the finest level.
MOST_EDGES, STEP, FINEST = 16, 2, 24
_CELL = ("_level", "_cx", "_cy")


# Tests on an edge ``e`` as SQL text, over columns or numbers that are named.


def _spans(y: str) -> str:
    return f"((e.y1 > {y}) <> (e.y2 > {y}))"


def _at(y: str) -> str:
    """Where an edge meets the height ``y``."""
    return f"((e.x2 - e.x1) * try_divide({y} - e.y1, e.y2 - e.y1) + e.x1)"


def _odd(edge_list: str, test: str) -> str:
    return f"(size(filter({edge_list}, e -> {test})) % 2 = 1)"


def _crossed_below(edge_list: str, right: str, y: str) -> str:
    """Parity of the edges that cross the vertical line ``right`` below the height ``y``.

    Where an edge crosses the line is told from where it meets the height, so that both tests agree.
    """
    rising, beyond = "((e.x2 > e.x1) = (e.y2 > e.y1))", f"({_at(y)} > {right})"
    below = f"if({_spans(y)}, {rising} = {beyond}, e.y1 <= {y})"
    return _odd(edge_list, f"((e.x1 > {right}) <> (e.x2 > {right})) and {below}")


def _inside(edge_list: str, parity: str, right: str, x: str, y: str) -> str:
    """Even-odd rule for a point of a cell; ``parity`` is that of the corner and the crossings below it."""
    ray = _odd(edge_list, f"{_spans(y)} and {x} < {_at(y)} and {_at(y)} <= {right}")
    return f"(({parity} <> {ray}) <> {_crossed_below(edge_list, right, y)})"


def _on_edge(edge_list: str, x: str, y: str) -> str:
    return f"""exists({edge_list}, e -> (e.x2 - e.x1) * ({y} - e.y1) = (e.y2 - e.y1) * ({x} - e.x1)
      and {x} between least(e.x1, e.x2) and greatest(e.x1, e.x2) and {y} between least(e.y1, e.y2) and greatest(e.y1, e.y2))"""


def _in_reach(edge_list: str, left: str, low: str, size: str) -> str:
    """Edges that may touch a closed cell: boxes overlap and the corners are not all to one side."""
    right, high = f"({left} + {size})", f"({low} + {size})"
    side = lambda x, y: f"((e.x2 - e.x1) * ({y} - e.y1) - (e.y2 - e.y1) * ({x} - e.x1))"
    sides = ", ".join(side(x, y) for x in (left, right) for y in (low, high))
    slack = f"((abs(e.x2 - e.x1) + abs(e.y2 - e.y1)) * {size} * 1e-9D)"
    return f"""filter({edge_list}, e -> greatest(e.x1, e.x2) >= {left} and least(e.x1, e.x2) <= {right}
      and greatest(e.y1, e.y2) >= {low} and least(e.y1, e.y2) <= {high}
      and greatest({sides}) >= -{slack} and least({sides}) <= {slack})"""


class Frame:
    """The square that cells divide: its lower left corner and side."""

    def __init__(self, x: float, y: float, side: float):
        self.x, self.y, self.side = x, y, side

    @classmethod
    def around(cls, boxes: DataFrame, box: str) -> Frame:
        at = boxes.agg(F.min(f"{box}.xmin"), F.min(f"{box}.ymin"), F.max(f"{box}.xmax"), F.max(f"{box}.ymax")).first()
        if at[0] is None:
            return cls(0.0, 0.0, 1.0)
        side = max(at[2] - at[0], at[3] - at[1]) or 1.0
        return cls(at[0], at[1], side * (1 + 1e-9))

    def size(self, level: Column) -> Column:
        return F.lit(self.side) / F.pow(F.lit(2.0), level)

    def slot(self, c: Column, axis: str, level: Column) -> Column:
        low = self.x if axis == "x" else self.y
        return F.floor((c - low) / self.size(level)).cast("bigint")

    def corner(self, slot: Column, axis: str, level: Column) -> Column:
        return F.lit(self.x if axis == "x" else self.y) + slot * self.size(level)


    def placed(self, cells: DataFrame) -> DataFrame:
        """Cells with their sides: ``_left``, ``_low``, ``_size`` and ``_right``."""
        level = F.col("_level")
        left = self.corner(F.col("_cx"), "x", level)
        right = self.corner(F.col("_cx") + 1, "x", level)
        low = self.corner(F.col("_cy"), "y", level)
        return cells.withColumns({"_left": left, "_right": right, "_low": low, "_size": self.size(level)})


def _described(cells: DataFrame) -> DataFrame:
    """Placed cells with the edges in their reach, and ``_parity`` (of the corner) made that of corner and crossings below."""
    reach = F.expr(_in_reach("_edges", "_left", "_low", "_size"))
    crossed = F.expr(f"_parity <> {_crossed_below('_edges', '_right', '_low')}")
    return cells.withColumn("_edges", reach).withColumn("_parity", crossed).drop("_left", "_right", "_low", "_size")


@dataclass
class Cover:
    """Cells of polygons: ``_level``, ``_cx``, ``_cy``, ``_parity``, ``_edges`` (none: wholly inside), and the attributes.

    ``size`` is what they hold in memory, ``levels`` those that occur.
    """

    cells: DataFrame
    frame: Frame
    size: int
    levels: list[int]


def cover(polygons: DataFrame, attributes: Sequence[str], rings: str = "rings", most_edges: int = MOST_EDGES) -> Cover:
    """Cells of every polygon.

    Rounds divide the crowded cells of all polygons together; each round is written.
    """
    shapes = settle(polygons.select(*attributes, edges(rings).alias("_edges"), bounding_box(rings).alias("_box")))
    frame = Frame.around(shapes, "_box")
    extent = F.greatest(F.col("_box.xmax") - F.col("_box.xmin"), F.col("_box.ymax") - F.col("_box.ymin"))
    own = F.when(extent > 0, F.floor(F.log2(frame.side / extent) / STEP) * STEP).otherwise(F.lit(FINEST))
    level = F.least(F.greatest(own, F.lit(0)), F.lit(FINEST)).cast("int")
    first = shapes.filter(F.size("_edges") > 0).withColumn("_level", level)
    for a in "xy":
        span = F.sequence(*[frame.slot(F.col(f"_box.{a}{end}"), a, F.col("_level")) for end in ("min", "max")])
        first = first.withColumn(f"_c{a}", F.explode(span))
    corner = F.expr(_odd("_edges", f"{_spans('_low')} and {_at('_low')} > _right"))
    frontier = _described(frame.placed(first.drop("_box")).withColumn("_parity", corner))
    crowded = (F.size("_edges") > most_edges) & (F.col("_level") < FINEST)
    done, size, levels = [], 0, set()
    while True:
        frontier, own_size = measured(frontier.filter((F.size("_edges") > 0) | F.col("_parity")))
        size += own_size
        done.append(frontier.filter(~crowded))
        seen = frontier.agg(F.collect_set(F.when(~crowded, F.col("_level"))).alias("levels"), F.max(crowded).alias("more")).first()
        levels |= set(seen["levels"])
        if not seen["more"]:
            break
        frontier = _described(frame.placed(_divided(frontier.filter(crowded), frame)))
    return Cover(reduce(DataFrame.unionByName, done), frame, size, sorted(levels))


def _divided(cells: DataFrame, frame: Frame) -> DataFrame:
    """Parts of cells with the parity of their own corners."""
    step = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2**STEP - 1).cast("bigint")))
    parts = cells.withColumn("_side", frame.corner(F.col("_cx") + 1, "x", F.col("_level")))
    parts = parts.withColumn("_dx", step).withColumn("_dy", step)
    parts = parts.withColumns(
        {
            "_level": F.col("_level") + STEP,
            "_cx": F.col("_cx") * 2**STEP + F.col("_dx"),
            "_cy": F.col("_cy") * 2**STEP + F.col("_dy"),
        }
    )
    parts = frame.placed(parts).withColumn("_x", F.least("_side", "_right"))
    inside = F.expr(_inside("_edges", "_parity", "_side", "_x", "_low"))
    return parts.withColumn("_parity", inside).drop("_side", "_dx", "_dy", "_x", "_left", "_right", "_low", "_size")


def locate(
    points: DataFrame, x: str, y: str, polygons: DataFrame, attributes: Sequence[str], rings: str = "rings"
) -> DataFrame:
    """Left join of points to the polygons that contain them, boundaries included.

    Points are written with a row number, and only that and the coordinates take part in the search, once for
    every level that the cover has. A point comes out once per hit, or once without.
    """
    covered = cover(polygons, attributes, rings)
    frame = covered.frame
    numbered = settle(points.withColumn("_row", F.monotonically_increasing_id()))
    at = numbered.select("_row", F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    at = at.filter(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    levels = F.array(*[F.lit(k) for k in covered.levels]).cast("array<int>")
    asked = at.withColumn("_level", F.explode(levels))
    asked = asked.withColumns({f"_c{a}": frame.slot(F.col(f"_{a}"), a, F.col("_level")) for a in "xy"})
    asked = asked.withColumn("_right", frame.corner(F.col("_cx") + 1, "x", F.col("_level")))
    hit = F.expr(f"{_inside('_edges', '_parity', '_right', '_x', '_y')} or {_on_edge('_edges', '_x', '_y')}")
    met = attach(asked, covered.cells, _CELL, ["_row"], "inner", size=covered.size)
    return attach(numbered, met.filter(hit).select("_row", *attributes), ["_row"], ["_row"]).drop("_row")
