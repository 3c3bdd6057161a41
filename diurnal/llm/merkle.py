"""Merkle manifest of a dataset: one tree per group of rows, and one over the groups (operator 11).

A row's leaf is the SHA-256 of its columns, each with its length. Inside a group leaves ascend by
key; every ``fanout`` consecutive nodes become the digest of their digests until one is left, the
group's subroot; subroots, in the order of their groups, become the root in the same way.

Texts are read once, to hash them; everything after moves digests. Places in a group come from
one range sort of the digests and the counts of its ranges, so that a group with a third of all rows
is many ranges. Each level is a sibling-shift self-join: a node equijoins the nodes at its
computed sibling indices (``i xor 1`` where nodes pair up, slot offsets otherwise), at most one row
for each, and the rows at slot zero emit the parents. Levels are written, so a lost executor
re-reads files. Proofs go the other way, each node taking the path of its parent: a key of these joins
has at most ``fanout`` rows. The driver gets the root and the count of the largest group.

Rows without key come first in their group, rows with equal keys go by leaf, and equal rows are
leaves of their own. Rows without group are a group, the first. Null columns are hashed as such. A
group of one row has its leaf as subroot; a single subroot is the root. An empty table
has no root and no proofs. Only the hashed columns, the key and the group are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import write_once

#: Leaves of one range of the sort, about.
RANGE_ROWS = 200_000
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_NOTHING = "array<struct<left:binary,right:binary>>"


def digest(data: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(data, 256))


def joined_digest(*digests: Column) -> Column:
    """Digest of digests, concatenated as lowercase hex text."""
    return digest(F.lower(F.hex(F.concat(*digests))))


def leaf_digest(values: Sequence[Column]) -> Column:
    """Digest of columns: ``-`` for a null, else UTF-8 byte count, ``:`` and value."""
    texts = [v.cast("string") for v in values]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def changed_leaf(columns: Sequence[str] = COLUMNS, **new: Column) -> Column:
    """The leaf that rows would have with the columns ``new`` in place of their own."""
    return leaf_digest([new.get(c, F.col(f"`{c}`")) for c in columns])


def leaves(docs: DataFrame, columns: Sequence[str] = COLUMNS, key: str = "doc_id", group: str = "source", **more: Column) -> DataFrame:
    """``group``, ``key``, ``leaf`` and columns ``more`` of every row, written."""
    picked = docs.select(F.col(f"`{group}`").alias("group"), F.col(f"`{key}`").alias("key"), changed_leaf(columns).alias("leaf"), *[c.alias(n) for n, c in more.items()])
    return write_once(picked, "merkle-leaves")


def sibling_index(i: Column, fanout: int, shift: int) -> Column:
    """Index of the node ``shift`` slots on, round the run of ``fanout`` nodes that ``i`` is in."""
    if fanout == 2:
        return i.bitwiseXOR(F.lit(1).cast("long"))
    slot = i % fanout
    return i - slot + (slot + shift) % fanout


def with_siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    """Nodes with the digests ``left`` and ``right`` of them in their run, each in order."""
    own = nodes
    beside = nodes.select(F.col("g").alias("g_"), F.col("i").alias("i_"), F.col("digest").alias("d_"))
    found = []
    for shift in range(1, fanout):
        at = sibling_index(F.col("i"), fanout, shift)
        other = beside.toDF("g_", "i_", f"d_{shift}")
        own = own.join(other, (F.col("g") == F.col("g_")) & (at == F.col("i_")), "left").drop("g_", "i_")
        found.append(F.struct(at.alias("i"), F.col(f"d_{shift}").alias("d")))
    there = F.array_sort(F.filter(F.array(*found), lambda s: s.d.isNotNull()))
    put = lambda side: F.aggregate(F.filter(there, side), F.lit(b""), lambda all_, s: F.concat(all_, s.d))
    own = own.withColumns({"left": put(lambda s: s.i < F.col("i")), "right": put(lambda s: s.i > F.col("i"))})
    return own.drop(*[f"d_{s}" for s in range(1, fanout)])


def parents(level: DataFrame, fanout: int) -> DataFrame:
    """Nodes of the next level, emitted by the rows at slot zero."""
    up = joined_digest(F.col("left"), F.col("digest"), F.col("right"))
    n = F.ceil(F.col("n") / fanout).cast("long")
    return level.where(F.col("i") % fanout == 0).select("g", F.floor(F.col("i") / fanout).cast("long").alias("i"), n.alias("n"), up.alias("digest"))


@dataclass
class Trees:
    """One tree per ``g`` over nodes ``g, i, n, digest``: written levels, and each tree's top."""

    fanout: int
    levels: list[DataFrame]
    tops: DataFrame  #: g, level, digest; columns carried by leaves of trees of one node

    @classmethod
    def over(cls, nodes: DataFrame, fanout: int, carried: Sequence[str] = ()) -> Trees:
        levels, tops = [], None
        most = nodes.agg(F.max("n")).first()[0] or 0
        while True:
            top = nodes.where("n = 1").select("g", F.lit(len(levels)).alias("level"), "digest", *[c if not levels else F.lit(None).cast(tops.schema[c].dataType).alias(c) for c in carried])
            tops = top if tops is None else tops.unionByName(top)
            if most <= 1:
                return cls(fanout, levels, write_once(tops, "merkle-tops"))
            levels.append(write_once(with_siblings(nodes.where("n > 1"), fanout), f"merkle-level-{len(levels)}"))
            nodes = parents(levels[-1], fanout)
            most = -(-most // fanout)

    def paths(self, above: DataFrame | None = None, carried: Sequence[str] = ()) -> DataFrame:
        """``g``, ``i``, ``path`` and ``top`` of every leaf, siblings level by level.

        ``above`` (g, ``path``) goes on from each tree's top.
        """
        none = F.array().cast(_NOTHING)
        tops = self.tops.withColumn("path", none) if above is None else self.tops.join(above, "g")
        tops = write_once(tops.withColumnRenamed("digest", "top"), "merkle-top-paths")
        at_top = lambda level: tops.where(F.col("level") == level).select("g", F.lit(0).cast("long").alias("i"), "path", "top", *(carried if level == 0 else ()))
        known = at_top(len(self.levels))
        for k in range(len(self.levels) - 1, -1, -1):
            more = carried if k == 0 else ()
            above_it = known.select(F.col("g").alias("g_"), F.col("i").alias("i_"), F.col("path").alias("path_"), "top")
            up = F.floor(F.col("i") / self.fanout).cast("long")
            own = self.levels[k].join(above_it, (F.col("g") == F.col("g_")) & (up == F.col("i_")))
            path = F.concat(F.array(F.struct("left", "right")), F.col("path_")).cast(_NOTHING)
            known = own.select("g", "i", path.alias("path"), "top", *more).unionByName(at_top(k))
        return known


@dataclass
class Manifest:
    """Both tiers of trees; ``root`` is None for an empty table."""

    groups: DataFrame  #: g, group, n, subroot
    by_group: Trees
    over_groups: Trees
    root: bytes | None
    carried: list[str]

    def proofs(self) -> DataFrame:
        """``key``, ``leaf``, ``subroot``, ``path`` and the carried columns of every row."""
        above = self.over_groups.paths().select(F.col("i").alias("g"), "path")
        out = self.by_group.paths(above, ["key", "leaf", *self.carried])
        return out.select("key", "leaf", F.col("top").alias("subroot"), "path", *self.carried)


def proof_digest(path: Column) -> Column:
    """Lowercase hex SHA-256 of all siblings of a path, in order, as hex text."""
    together = F.aggregate(path, F.lit(b""), lambda all_, s: F.concat(all_, s.left, s.right))
    return F.sha2(F.lower(F.hex(together)), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings on its path."""
    return F.aggregate(path, leaf, lambda d, s: joined_digest(s.left, d, s.right))


def _placed(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves with the number ``g`` of their group, place ``i`` in it and its size ``n``; the groups.

    A row's place is its distance from the group's first row in the range, and what the ranges before
    have of the group. Windows see one row per range and group, and one per range.
    """
    order = ["group", "key", "leaf"]
    ranges = max(1, -(-found.count() // RANGE_ROWS))
    dealt = found.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    dealt = write_once(dealt.withColumn("at", F.monotonically_increasing_id()), "merkle-sorted")
    dealt = dealt.withColumn("range", F.shiftright("at", 33))  # a row's number begins with its partition
    spans = dealt.groupBy("range", "group").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    same, earlier = Window.partitionBy("group"), Window.partitionBy("group").orderBy("range")
    before = earlier.rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumns({"before": F.coalesce(F.sum("rows").over(before), F.lit(0)), "n": F.sum("rows").over(same)})
    spans = write_once(spans, "merkle-spans")
    begun = spans.where("before = 0")
    per_range = begun.groupBy("range").agg(F.count("*").alias("begun"))
    until = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    per_range = per_range.withColumn("groups_before", F.coalesce(F.sum("begun").over(until), F.lit(0))).drop("begun")
    number = F.col("groups_before") + F.row_number().over(Window.partitionBy("range").orderBy("group")) - 1
    groups = write_once(begun.join(per_range, "range").select("group", number.cast("long").alias("g"), "n"), "merkle-groups")
    spans = spans.drop("n").withColumnRenamed("group", "group_")
    spans = spans.join(groups, F.col("group_").eqNullSafe(F.col("group"))).select("range", "group_", "first", "before", "g", "n")
    spans = write_once(spans.withColumnRenamed("range", "range_"), "merkle-places")
    placed = dealt.join(spans, (F.col("range") == F.col("range_")) & F.col("group").eqNullSafe(F.col("group_")))
    placed = placed.withColumn("i", F.col("at") - F.col("first") + F.col("before"))
    return placed.drop("at", "range", "range_", "group", "group_", "first", "before"), groups


def build(found: DataFrame, fanout: int = 3) -> Manifest:
    """Manifest over the rows of :func:`leaves`."""
    carried = [c for c in found.columns if c not in ("group", "key", "leaf")]
    placed, groups = _placed(found)
    nodes = write_once(placed.withColumn("digest", F.col("leaf")), "merkle-placed")
    trees = Trees.over(nodes, fanout, ["key", "leaf", *carried])
    subroots = write_once(groups.join(trees.tops.select("g", F.col("digest").alias("subroot")), "g"), "merkle-subroots")
    count = subroots.count()
    tier = subroots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("i"), F.lit(count).cast("long").alias("n"), F.col("subroot").alias("digest"))
    over = Trees.over(tier, fanout)
    top = over.tops.first()
    return Manifest(subroots, trees, over, bytes(top["digest"]) if top else None, carried)
