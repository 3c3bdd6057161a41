"""Exact top-k search by inner product: Voronoi kNN join (operator 3).

Components are floored to integers, ``floor(256 x)``. Adding one coordinate
``sqrt(M^2 - |x|^2)`` (0 for queries, M the largest norm) turns largest inner products into
nearest neighbours, so distance bounds hold. Pivots cut the space into Voronoi cells.
Summaries of the data's cells (their smallest distances) bound, for each query by itself, the
distance within which its k + 1 best must lie. For the queries of a cell this gives a range of distances
from its pivot, and a vector is sent to a group of query cells only if it lies in the range of one of them.
Groups are solved with exact integer scores, slice by slice of the data that was sent to them, and partial lists are merged.
How much is sent depends on the data: vectors in clusters go to few groups, while directions drawn at random in
many dimensions are all about as far from each other, and no bound on distances keeps any of them away.

Equal vectors are folded first (only their k + 1 smallest ids can count), so a vector that
a third of the rows share is one row. Query groups hold about ``GROUP`` queries and slices
about ``SLICE`` vectors whatever the input; a group has as many slices as it was sent vectors for. There is
about one pivot for the square root of the vectors, at most ``PIVOTS``, which bounds summaries too.

Vectors that are null, or hold null or non-finite components, and rows without id take no part, nor does
an empty vector. Shorter vectors count as padded with zeros. A row repeated with equal id and
vector counts once; of rows that share an id but not the vector, each is a query, and all are
left out for it. Ties go to the smaller id. A product beyond the range of a long counts as its largest or smallest
value, as do components. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import write_once

#: Most pivots, queries per group, and vectors per slice of the data.
PIVOTS, GROUP, SLICE = 4096, 1024, 2048
#: Slack of the floating-point bounds, relative to the largest norm (distances are roots of differences); scores themselves are exact.
SLACK = 1e-7
#: Queries whose bounds are computed at once.
_AT_ONCE = 256


def integer_components(vectors: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of each component as long; null where the vector takes no part."""
    floats = vectors.cast("array<double>")
    bad = F.exists(floats, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vectors.isNotNull() & (F.size(vectors) > 0) & ~bad, F.transform(floats, lambda x: F.floor(x * scale).cast("long")))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    rows = column.to_pylist()
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


class Pivots:
    """Pivots in the space with the added coordinate."""

    def __init__(self, points: np.ndarray, square: int):
        self.width, self.square = points.shape[1], float(square)
        self.points = self.raised(points)

    def raised(self, x: np.ndarray, queries: bool = False) -> np.ndarray:
        own = x.astype(float)
        extra = np.zeros(len(own)) if queries else np.sqrt(np.maximum(self.square - (own * own).sum(1), 0))
        return np.concatenate([own, extra[:, None]], 1)

    def distances(self, x: np.ndarray, queries: bool = False) -> np.ndarray:
        own = self.raised(x, queries)
        square = (own * own).sum(1)[:, None] - 2 * own @ self.points.T + (self.points * self.points).sum(1)
        return np.sqrt(np.maximum(square, 0))


def _best(scores: np.ndarray, ids: list[list[int]], k: int) -> list[tuple[int, int]]:
    """The ``k`` best (score, id) of one query, ties to the smaller id."""
    least = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) > k else scores.min()
    found = [(-int(scores[v]), i) for v in np.flatnonzero(scores >= least) for i in ids[v]]
    return [(-s, i) for s, i in sorted(found)[:k]]


def _scores(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Exact integer products: in floats where these are exact, else in integers; held to the range of a long."""
    q, x = (np.abs(m.astype(float)).max(1, initial=0) for m in (queries, data))
    top = q.max(initial=0) * x.max(initial=0) * queries.shape[1]
    if top < 2**53:
        return (queries.astype(float) @ data.T.astype(float)).astype(np.int64)
    out = queries @ data.T
    for i, j in np.argwhere(q[:, None] * x * queries.shape[1] >= 2**62):
        exact = sum(a * b for a, b in zip(queries[i].tolist(), data[j].tolist(), strict=True))
        out[i, j] = max(-(2**63), min(2**63 - 1, exact))
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of each query's ``k`` best.

    ``queries`` are rows of the same shape; a row of ``vectors`` with the query's own id is
    no candidate.
    """
    prepared = [F.col(key).cast("long").alias("id"), integer_components(F.col(vector)).alias("v")]
    data = vectors.select(*prepared).where("id is not null and v is not null")
    asked = write_once(queries.select(*prepared).where("id is not null and v is not null").distinct(), "knn-queries")
    # only the k + 1 smallest ids of equal vectors can be among a query's best
    order = Window.partitionBy("v").orderBy("id")
    folded = data.withColumn("place", F.dense_rank().over(order)).where(F.col("place") <= k + 1)
    distinct = write_once(folded.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids")), "knn-vectors")
    own = write_once(asked.groupBy("v").agg(F.min("id").alias("query")), "knn-distinct-queries")
    best = write_once(_solve(distinct, own, k + 1), "knn-best")
    # queries with equal vectors share one solution; both sides are written tables
    named = write_once(asked.join(own, "v").select(F.col("id").alias("query_id"), "query"), "knn-names")
    found = named.join(best, "query").where("query_id <> id").select("query_id", F.col("id").alias("vec_id"), "score").distinct()
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


@dataclass
class Plan:
    """Who meets whom: query cells in groups, their ranges of distances, and the parts of each group."""

    width: int
    pivots: Pivots
    members: list[list[int]]  #: cells of each group
    near: dict[int, float]  #: per query cell, the least and the largest distance of a needed vector
    far: dict[int, float]
    parts: list[range]  #: of the queries of each group
    slices: list[int]  #: of the data sent to each group
    sent: list[int]
    vectors: int

    @property
    def share(self) -> float:
        """Vectors sent, of all that could be sent to all groups."""
        return sum(self.sent) / max(1, self.vectors * len(self.members))

    def needed(self, v: np.ndarray) -> np.ndarray:
        """Vectors x groups: whether a group needs a vector."""
        d = self.pivots.distances(v)
        return np.stack([((d[:, m] >= [self.near[c] for c in m]) & (d[:, m] <= [self.far[c] for c in m])).any(1) for m in self.members], 1)


def plan(distinct: DataFrame, own: DataFrame, k: int) -> Plan | None:
    """Pivots, bounds and groups for the ``k`` best of each distinct query vector; None if either side is empty."""
    spark = distinct.sparkSession
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    shape = distinct.agg(F.count("*").alias("n"), F.max(norm).alias("square"), F.max(F.size("v")).alias("width")).first()
    asked = own.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    if not shape["n"] or not asked["n"]:
        return None
    width, n = max(shape["width"], asked["width"]), shape["n"]
    picked = distinct.orderBy(F.xxhash64("v"), "v").limit(int(min(PIVOTS, max(1, np.sqrt(n))))).select("v").collect()
    points = np.zeros((len(picked), width), np.int64)
    for i, r in enumerate(picked):
        points[i, : len(r["v"])] = r["v"]
    pivots = Pivots(points, shape["square"])
    shared = spark.sparkContext.broadcast(pivots)  # at most PIVOTS vectors

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = shared.value.distances(_matrix(batch.column(0), width))
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], names=["cell", "d"])

    of_data = distinct.select("v").mapInArrow(place, "cell int, d double")
    nearest = of_data.withColumn("place", F.row_number().over(Window.partitionBy("cell").orderBy("d"))).where(F.col("place") <= k).select("cell", "d")
    kept = np.array([(r["cell"], r["d"]) for r in nearest.collect()])  # at most k rows per cell
    summary = spark.sparkContext.broadcast((kept[:, 0].astype(int), kept[:, 1]))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per query its cell, and the distances from the cell's pivot between which its best lie."""
        cells, distances = summary.value
        for batch in batches:
            for at in range(0, batch.num_rows, _AT_ONCE):
                d = shared.value.distances(_matrix(batch.column(0).slice(at, _AT_ONCE), width), True)
                near = d.argmin(1)
                home = d[np.arange(len(d)), near]
                upper = d[:, cells] + distances
                reach = np.partition(upper, k - 1, 1)[:, k - 1] if upper.shape[1] >= k else np.full(len(d), np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(home - reach), pa.array(home + reach)], names=["cell", "least", "most"])

    ranges = own.select("v").mapInArrow(bound, "cell int, least double, most double")
    ranges = ranges.groupBy("cell").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.count("*").alias("n")).collect()
    slack = SLACK * (1 + float(np.sqrt(shape["square"])) + max([0.0, *(r["most"] for r in ranges if np.isfinite(r["most"]))]))
    between = np.sqrt(np.maximum(((pivots.points[ranges[0]["cell"]] - pivots.points) ** 2).sum(1), 0))
    members: list[list[int]] = []
    sizes: list[int] = []
    for r in sorted(ranges, key=lambda r: (between[r["cell"]], r["cell"])):  # neighbouring cells share a group
        if not members or sizes[-1] + r["n"] > GROUP:
            members.append([])
            sizes.append(0)
        members[-1].append(r["cell"])
        sizes[-1] += r["n"]
    starts = np.cumsum([0, *(-(-x // GROUP) for x in sizes)]).tolist()
    made = Plan(
        width, pivots, members, {r["cell"]: r["least"] - slack for r in ranges}, {r["cell"]: r["most"] + slack for r in ranges},
        [range(a, b) for a, b in zip(starts[:-1], starts[1:], strict=True)], [], [], n,
    )
    tried = spark.sparkContext.broadcast(made)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(members), np.int64)
        for batch in batches:
            if batch.num_rows:
                total += tried.value.needed(_matrix(batch.column(0), width)).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(members), dtype=np.int32)), pa.array(total)], names=["group", "n"])

    counts = {r["group"]: r["n"] for r in distinct.select("v").mapInArrow(count, "group int, n long").groupBy("group").agg(F.sum("n").alias("n")).collect()}
    made.sent = [counts.get(g, 0) for g in range(len(members))]
    made.slices = [max(1, -(-x // SLICE)) for x in made.sent]
    return made


def _solve(distinct: DataFrame, own: DataFrame, k: int) -> DataFrame:
    """``query``, ``id``, ``score``: the ``k`` best of each distinct query vector."""
    spark = distinct.sparkSession
    made = plan(distinct, own, k)
    if made is None:
        return spark.createDataFrame([], "query long, id long, score long")
    shared, width = spark.sparkContext.broadcast(made), made.width
    group_of = {c: g for g, own_cells in enumerate(made.members) for c in own_cells}

    def send_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A query goes to one part of its group, once for each slice of the group's data."""
        p = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            near = p.pivots.distances(_matrix(batch.column(0), width), True).argmin(1)
            q, group = batch.column(1).to_numpy(), np.array([group_of[c] for c in near.tolist()])
            block = np.array([p.parts[g][int(i) % len(p.parts[g])] for g, i in zip(group.tolist(), q.tolist(), strict=True)], np.int32)
            copies = np.array([p.slices[g] for g in group.tolist()])
            for s in range(copies.max()):
                at = np.flatnonzero(copies > s)
                rows = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(block[at]), pa.array(np.full(len(at), s, np.int32)), *rows.columns], names=["block", "slice", "v", "query"])

    def send_data(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A vector goes to one slice of every group that needs it, once for each part of the group's queries."""
        p = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            needed, hashed = p.needed(_matrix(batch.column(0), width)), batch.column(2).to_numpy()
            for g, blocks in enumerate(p.parts):
                at = np.flatnonzero(needed[:, g])
                rows = batch.take(pa.array(at))
                part = pa.array((hashed[at] % p.slices[g]).astype(np.int32))
                for b in blocks:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), b, np.int32)), part, rows.column(0), rows.column(1)], names=["block", "slice", "v", "ids"])

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            q, x = _matrix(left.column("v"), width), _matrix(right.column("v"), width)
            ids = right.column("ids").to_pylist()
            for query, scores in zip(left.column("query").to_pylist(), _scores(q, x), strict=True):
                out += [(query, i, s) for s, i in _best(scores, ids, k)]
        return pa.table({c: pa.array([r[i] for r in out], pa.int64()) for i, c in enumerate(("query", "id", "score"))})

    asked_rows = own.select("v", "query").mapInArrow(send_queries, "block int, slice int, v array<long>, query long")
    hashed = distinct.select("v", "ids", F.pmod(F.xxhash64("v"), F.lit(1 << 30)).alias("h"))
    data_rows = hashed.mapInArrow(send_data, "block int, slice int, v array<long>, ids array<long>")
    partial = asked_rows.groupBy("block", "slice").cogroup(data_rows.groupBy("block", "slice")).applyInArrow(solve, "query long, id long, score long")
    merged = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return partial.withColumn("place", F.row_number().over(merged)).where(F.col("place") <= k).drop("place")
