"""Outlines of groups of polygons as closed, oriented rings.

Edges are cut at the corners that lie on them, so neighbours whose corners do not match (T-junctions) share
pieces; pieces used in both directions cancel. What is left is linked to rings: at a corner the next piece is the
one that bounds the same land, and rings are found and ordered by pointer jumping, whose rounds are
as many as the binary digits of the longest ring. No group is assembled in one task, only each ring.

Joins carry a merge hint: files of corners and links compress so well that Catalyst would broadcast tables of
gigabytes through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shapes import edges
from ..session import settle
from .joins import natural_join

_ENDS = ("x1", "y1", "x2", "y2")


def _signed_area(edge_list: str) -> Column:
    return F.expr(f"aggregate({edge_list}, 0D, (a, e) -> a + (e.x1 * e.y2 - e.x2 * e.y1)) / 2")


def directed_edges(polygons: DataFrame, group: Sequence[str], rings: str = "rings") -> DataFrame:
    """Edges with their polygon to the left. Holes run against their outer ring, whichever way that runs."""
    own = polygons.select(*group, edges(rings).alias("_edges")).withColumn("_area", _signed_area("_edges"))
    turned = F.expr("transform(_edges, e -> if(_area < 0, named_struct('x1', e.x2, 'y1', e.y2, 'x2', e.x1, 'y2', e.y1), e))")
    e = own.select(*group, F.explode(turned).alias("e")).select(*group, *[F.col(f"e.{c}").alias(c) for c in _ENDS])
    return e.filter("x1 <> x2 or y1 <> y2")


def noded(e: DataFrame, group: Sequence[str], tolerance: float) -> DataFrame:
    """Edges cut at the corners of their group that lie within ``tolerance`` of them.

    Corners and edges meet in cells about as wide as an edge is long; an edge is listed under the cells
    it passes, row by row.
    """
    e = settle(e)
    long = e.agg(F.avg(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))).first()[0]
    if long is None:
        return e
    cell = max(2 * long, 10 * tolerance)
    slot = lambda c: F.floor(c / cell).cast("bigint")
    ends = [e.select(*group, F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in (1, 2)]
    corners = ends[0].unionByName(ends[1]).distinct().withColumns({"_cx": slot(F.col("x")), "_cy": slot(F.col("y"))})
    low, high = F.least("y1", "y2") - tolerance, F.greatest("y1", "y2") + tolerance
    rows = e.distinct().withColumn("_cy", F.explode(F.sequence(slot(low), slot(high))))
    # where the edge enters and leaves the row
    slope = F.try_divide(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    at = lambda y: F.coalesce(F.col("x1") + slope * (F.greatest(F.least(y, F.greatest("y1", "y2")), F.least("y1", "y2")) - F.col("y1")))
    inside = [at(F.col("_cy") * cell - tolerance), at((F.col("_cy") + 1) * cell + tolerance)]
    flat = F.col("y1") == F.col("y2")
    left = F.when(flat, F.least("x1", "x2")).otherwise(F.least(*inside)) - tolerance
    right = F.when(flat, F.greatest("x1", "x2")).otherwise(F.greatest(*inside)) + tolerance
    listed = rows.withColumn("_cx", F.explode(F.sequence(slot(left), slot(right))))
    met = natural_join(listed, corners.hint("merge"), "inner", [*group, "_cx", "_cy"])
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    size = F.hypot(dx, dy)
    along = ((F.col("x") - F.col("x1")) * dx + (F.col("y") - F.col("y1")) * dy) / size
    beside = F.abs((F.col("x") - F.col("x1")) * dy - (F.col("y") - F.col("y1")) * dx) / size
    on = met.filter((beside <= tolerance) & (along > tolerance) & (along < size - tolerance))
    cuts = on.groupBy(*group, *_ENDS).agg(F.array_sort(F.collect_set(F.struct(along.alias("t"), "x", "y"))).alias("_cuts"))
    cut = natural_join(e, cuts.hint("merge"), "left", [*group, *_ENDS])
    path = F.expr(
        "concat(array(named_struct('x', x1, 'y', y1)), coalesce(transform(_cuts, c -> named_struct('x', c.x, 'y', c.y)), array()), array(named_struct('x', x2, 'y', y2)))"
    )
    pieces = F.expr("transform(sequence(1, size(_path) - 1), i -> named_struct('a', _path[i - 1], 'b', _path[i]))")
    out = cut.withColumn("_path", path).select(*group, F.explode(pieces).alias("p"))
    return out.select(*group, *[F.col(f"p.{p}.{c}").alias(f"{c}{k}") for k, p in ((1, "a"), (2, "b")) for c in "xy"])


def boundary(pieces: DataFrame, group: Sequence[str]) -> DataFrame:
    """Pieces that are left when those run through in both directions cancel, the land to the left."""
    first, second = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    net = pieces.groupBy(*group, F.least(first, second).alias("p"), F.greatest(first, second).alias("q")).agg(
        F.sum(F.when(first < second, 1).otherwise(-1)).alias("net")
    )
    left = net.filter("net <> 0")
    end = lambda c, there, back: F.when(F.col("net") > 0, F.col(f"{there}.{c}")).otherwise(F.col(f"{back}.{c}"))
    return left.select(
        *group, end("x", "p", "q").alias("x1"), end("y", "p", "q").alias("y1"), end("x", "q", "p").alias("x2"), end("y", "q", "p").alias("y2")
    )


def _linked(pieces: DataFrame, group: Sequence[str]) -> DataFrame:
    """Pieces with a number ``id``, and that of the next one: the first clockwise from where the piece came from."""
    own = settle(pieces.withColumn("id", F.monotonically_increasing_id()))
    out = own.select(
        *group, F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.col("id").alias("_to"), F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")).alias("_out")
    )
    back = F.atan2(F.col("y1") - F.col("y2"), F.col("x1") - F.col("x2"))
    turn = F.pmod(back - F.col("_out"), F.lit(2 * math.pi))
    met = natural_join(own.select(*group, "x2", "y2", "id", back.alias("_back"), "x1", "y1"), out.hint("merge"), "inner", [*group, "x2", "y2"])
    nexts = met.groupBy("id").agg(F.min_by("_to", F.when(turn > 1e-12, turn).otherwise(2 * math.pi)).alias("to"))
    return settle(own.join(nexts.hint("merge"), "id"))


def _jumped(state: DataFrame, new: dict[str, Column]) -> DataFrame:
    """One round of pointer jumping: ``t_`` columns are those of the piece that is pointed at."""
    there = state.select(*[F.col(c).alias(f"t_{c}") for c in state.columns])
    met = state.join(there.hint("merge"), F.col("to") == F.col("t_id"))
    return settle(met.withColumns(new).select(*state.columns))


def _ranked(linked: DataFrame) -> DataFrame:
    """Linked pieces with their ``ring`` (the piece at its smallest corner) and ``place``: that piece comes last, as 0."""
    state = linked.select("id", "to", F.struct("x1", "y1", "id").alias("head"))
    before = None
    while True:  # the smallest corner within 1, 2, 4, ... pieces ahead
        state = _jumped(state, {"head": F.least("head", "t_head"), "to": F.col("t_to")})
        now = state.agg(F.sum(F.xxhash64("head").cast("decimal(38,0)"))).first()[0]
        if now == before:
            break
        before = now
    order = linked.select("id", "to").join(state.select("id", F.col("head.id").alias("ring")).hint("merge"), "id")
    state = settle(order.withColumns({"steps": F.lit(1).cast("bigint"), "done": F.col("to") == F.col("ring")}))
    while not state.filter(~F.col("done")).isEmpty():  # pieces left to the head, 1, 2, 4, ... at a time
        go = ~F.col("done")
        state = _jumped(
            state,
            {
                "steps": F.when(go, F.col("steps") + F.col("t_steps")).otherwise(F.col("steps")),
                "to": F.when(go, F.col("t_to")).otherwise(F.col("to")),
                "done": F.col("done") | F.col("t_done"),
            },
        )
    place = F.when(F.col("id") == F.col("ring"), F.lit(0).cast("bigint")).otherwise(-F.col("steps"))
    return settle(linked.join(state.select("id", "ring", place.alias("place")).hint("merge"), "id"))


def rings(pieces: DataFrame, group: Sequence[str]) -> DataFrame:
    """Closed rings of boundary pieces: ``points``, ``area``, and whether it is a ``hole``.

    Outer rings run counterclockwise, holes clockwise; a ring begins at its smallest corner and passes no
    corner twice: where rings touch, each is a ring of its own.
    """
    placed = _ranked(_linked(pieces, group))
    # a ring that comes back to a corner is closed there: each stretch between visits goes on with its own first piece
    visits = Window.partitionBy("ring", "x1", "y1")
    before = F.lag("id").over(visits.orderBy("place"))
    last = F.max_by("id", "place").over(visits)
    again = placed.withColumn("_n", F.count(F.lit(1)).over(visits)).withColumn("_own", F.coalesce(before, last))
    again = settle(again.filter("_n > 1").select(F.col("id").alias("to"), "_own"))
    if not again.isEmpty():
        closed = placed.drop("ring", "place").join(again.hint("merge"), "to", "left").withColumn("to", F.coalesce("_own", "to"))
        placed = _ranked(settle(closed.drop("_own")))
    whole = placed.groupBy(*group, "ring").agg(F.array_sort(F.collect_list(F.struct("place", "x1", "y1"))).alias("_at"))
    # the head has place 0, so it is last in order; it is put first and repeated at the end
    points = F.expr("transform(concat(slice(_at, -1, 1), _at), p -> named_struct('x', p.x1, 'y', p.y1))")
    out = whole.withColumn("points", points).withColumn("_edges", edges(F.array("points")))
    out = out.withColumn("area", _signed_area("_edges"))
    return out.select(*group, "points", F.abs("area").alias("area"), (F.col("area") < 0).alias("hole"))


def outlines(polygons: DataFrame, group: Sequence[str], tolerance: float, rings_column: str = "rings") -> DataFrame:
    """Rings around the land of each group. ``tolerance`` is how far a corner may lie off an edge it belongs to."""
    e = directed_edges(polygons, group, rings_column)
    return rings(boundary(noded(e, group, tolerance), group), group)
