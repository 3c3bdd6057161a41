"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree (operator 1).

DataFrame functions only. A source's documents lie in ``blocks`` blocks by a hash of their
id, so a block is a random sample of its source, and blocks grow with the data while their
number does not. The target of a source in words becomes an exact quota of blocks: whole
passes over the source, then blocks in permuted order, the last one cut inside at the
document where the target is reached.

The quotas are dealt to ``2^levels`` output shards by a binary tree: each node halves its
number of blocks and draws how many of each source go left from the multivariate
hypergeometric distribution, one source after the other by inverting the distribution
function. Leaves draw disjoint stretches of each source's permuted list of blocks. Inside a shard, rows are
put in hashed order. Only quotas and block sums, bounded by sources x blocks, pass through the tree; the documents
are shuffled once, to their shard.

Targets: sources by code point, null last, weigh ``weights`` in turn and share ``share`` of
all words; a target stops at ``most`` times its source's words and the excess is shared by
weight among the others until none is above. All choices derive from hashes: reruns agree.

Null texts have no words; a document without words is taken with its block and counts 0.
Documents with equal id, source, size and text are the same row many times: they take places one after the other. An empty table
gives an empty one; without any words all targets are 0. Only the id, source and text columns are read by
:func:`plan`; :func:`mix_documents` carries all columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import write_once

#: Words: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Most rows of block draws that are broadcast.
BROADCAST_BLOCKS = 500_000
#: Stretches into which a shard's rows are dealt by their hashed place, each sorted alone.
_PARTS = 16


@dataclass(frozen=True)
class Mix:
    """Parameters of a mix."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    most: int = 2
    blocks: int = 1024
    levels: int = 6
    seed: str = "mix"


def sizes(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", carry: bool = False) -> DataFrame:
    """``key``, ``source``, ``size`` in words and ``mark`` (a hash of the text) per row.

    With ``carry`` the whole row comes along as the struct ``row``.
    """
    words = F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    own = [F.col(key).alias("key"), F.col(source).cast("string").alias("source"), words.alias("size"), F.xxhash64(F.col(text)).alias("mark")]
    return docs.select(*own, *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []))


def targets(sized: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``source``, ``source_size`` and ``target``: a row per source.

    Capped shares are a water level: sorted by the level at which each source is full
    (``most x size / weight``), the level that spends all words is the first that no unfilled source caps.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*map(F.lit, mix.weights))
    weighed = by_source.withColumn("weight", F.element_at(weights, (place % len(mix.weights) + 1).cast("int")).cast("long"))
    weighed = weighed.withColumn("cap", F.col("source_size") * mix.most).withColumn("full", F.col("cap") / F.col("weight"))
    order = Window.orderBy("full", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    words = F.sum("source_size").over(every) * F.lit(mix.share)
    spent, light = F.coalesce(F.sum("cap").over(before), F.lit(0)), F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (words - spent) / (F.sum("weight").over(every) - light)
    leveled = weighed.withColumn("level", level)
    fits = F.min(F.when(F.col("level") <= F.col("full"), F.struct("full", F.col("source").isNull(), "source", "level"))).over(every)
    chosen = leveled.withColumn("water", fits["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("water") * F.col("weight"), F.col("cap").cast("double")))
    return chosen.select("source", "source_size", target.alias("target"))


def _md5(mix: Mix, value: Column) -> Column:
    return F.md5(F.concat(F.lit(mix.seed + ":"), F.coalesce(value.cast("string"), F.lit(""))).cast("binary"))


def _blocked(sized: DataFrame, mix: Mix) -> DataFrame:
    """Rows with the ``order`` of their permutation and their ``block``."""
    digest = _md5(mix, F.col("key"))
    block = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % mix.blocks).cast("int")
    return sized.withColumn("order", F.substring(digest, 9, 24)).withColumn("block", block)


def _hypergeometric(kind: Column, rest: Column, draws: Column, u: Column) -> Column:
    """How many of ``kind`` items are among ``draws`` from ``kind + rest``, by inversion.

    Log weights follow from the ratio of neighbouring ones, relative to the smallest possible
    count; a first pass over the counts adds them up (scaled by the largest so far), a second
    one stops where the sum passes ``u`` of it.
    """
    low, high = F.greatest(F.lit(0).cast("long"), draws - rest), F.least(kind, draws)

    def ratio(x: Column) -> Column:  # of the weights of x + 1 and x
        return F.log((kind - x).cast("double") * (draws - x).cast("double") / ((x + 1).cast("double") * (rest - draws + x + 1).cast("double")))

    counts = F.sequence(low, high)
    first = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("top"), F.lit(0.0).alias("sum"))

    def add(s: Column, x: Column) -> Column:
        top = F.greatest(s["top"], s["log"])
        total = s["sum"] * F.exp(s["top"] - top) + F.exp(s["log"] - top)
        return F.struct(F.when(x < high, s["log"] + ratio(x)).otherwise(s["log"]).alias("log"), top.alias("top"), total.alias("sum"))

    whole = F.aggregate(counts, first, add, lambda s: s["top"] + F.log(s["sum"]))

    def stop(w: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("done"), F.lit(None).cast("long").alias("found"))

        def step(s: Column, x: Column) -> Column:
            done = s["done"] + F.exp(s["log"] - w)
            found = F.coalesce(s["found"], F.when((done >= u) | (x == high), x))
            return F.struct(F.when(x < high, s["log"] + ratio(x)).otherwise(s["log"]).alias("log"), done.alias("done"), found.alias("found"))

        return F.aggregate(counts, start, step, lambda s: s["found"])

    return F.element_at(F.transform(F.array(whole), stop), 1)


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def split_tree(quotas: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Deal block quotas (``source``, ``quota``) to shards: ``shard``, ``source``, ``first``, ``n``.

    ``first`` is where the shard's stretch of the source's permuted blocks begins. Every
    shard gets an equal number of blocks, up to one.
    """
    packed = F.sort_array(F.collect_list(F.struct(F.col("source").isNull().alias("none"), "source", F.col("quota").alias("n"))))
    nodes = quotas.agg(packed.alias("own")).select(F.lit(0).cast("long").alias("node"), "own")
    for level in range(mix.levels):
        total = F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x["n"])
        at_level = F.lit(level)
        state = F.struct((total - F.floor(total / 2)).alias("draws"), total.alias("left"), F.array().cast("array<bigint>").alias("drawn"))

        def draw(s: Column, x: Column) -> Column:
            u = _unit(F.lit(mix.seed), at_level, F.col("node"), F.coalesce(x["source"], F.lit("")), x["none"])
            n = _hypergeometric(x["n"], s["left"] - x["n"], s["draws"], u)
            return F.transform(F.array(n), lambda k: F.struct((s["draws"] - k).alias("draws"), (s["left"] - x["n"]).alias("left"), F.concat(s["drawn"], F.array(k)).alias("drawn")))[0]

        drawn = nodes.withColumn("drawn", F.aggregate("own", state, draw, lambda s: s["drawn"]))

        def part(right: bool) -> Column:
            k = F.zip_with("own", "drawn", lambda o, d: F.struct(o["none"].alias("none"), o["source"].alias("source"), (o["n"] - d if right else d).alias("n")))
            return F.struct((F.col("node") * 2 + int(right)).alias("node"), k.alias("own"))

        # a generator ends each level, so that the next one does not repeat its expressions
        nodes = drawn.select(F.explode(F.array(part(False), part(True))).alias("x")).select("x.node", "x.own")
    flat = nodes.select(F.col("node").cast("int").alias("shard"), F.explode("own").alias("x")).select("shard", "x.source", "x.n")
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return flat.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))


def block_draws(sized: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Per source and block: ``source_size``, ``target``, ``passes``, ``room`` and ``copies``.

    ``copies`` lists the shards that take the block, ``passes`` of them as a part of whole
    passes; ``room`` is set for the block that is cut inside, to the words it may give.
    """
    goal = write_once(targets(sized, mix), "mix-targets").withColumnRenamed("source", "s")
    sums = sized.groupBy("source", "block").agg(F.sum("size").alias("words"))
    joined = sums.join(goal, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    joined = joined.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    # the permuted order of a source's blocks, of which there are at most mix.blocks
    by_block = Window.partitionBy("source").orderBy(_md5(mix, F.col("block")), "block")
    placed = joined.withColumn("place", F.row_number().over(by_block) - 1)
    placed = placed.withColumn("before", F.coalesce(F.sum("words").over(by_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # blocks that begin before the target is reached; the last of them is cut inside
    placed = placed.withColumn("again", (F.col("before") < F.col("rest")).cast("int"))
    placed = placed.withColumn("room", F.when((F.col("again") == 1) & (F.col("before") + F.col("words") > F.col("rest")), F.col("rest") - F.col("before")))
    placed = write_once(placed.select("source", "block", "source_size", "target", "passes", "again", "place", "room"), "mix-blocks")
    # copies of blocks, one after the other: pass 0 of all blocks, pass 1 of all, and so on
    per_source = placed.groupBy("source").agg(F.count("*").alias("own"), (F.sum("passes") + F.sum("again")).alias("quota"))
    stretches = split_tree(per_source.select("source", "quota"), mix)
    stretch = stretches.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("first", "n", "shard"))).alias("stretches"))
    lists = per_source.join(stretch.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select("s", "own", "stretches")
    with_lists = placed.join(lists, F.col("source").eqNullSafe(F.col("s")))
    times = F.col("passes") + F.col("again")

    def shard(c: Column) -> Column:
        position = c * F.col("own") + F.col("place")
        return F.filter("stretches", lambda x: (x["first"] <= position) & (position < x["first"] + x["n"]))[0]["shard"]

    copies = F.when(times > 0, F.transform(F.sequence(F.lit(0).cast("long"), times - 1), shard)).otherwise(F.array().cast("array<int>"))
    return write_once(with_lists.select("source", "block", "source_size", "target", "passes", "room", copies.alias("copies")), "mix-draws")


def _drawn(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows with ``draws``: those of their block, but for the rows of a cut block past its target."""
    own = blocks.withColumnsRenamed({"source": "s", "block": "b"})
    if blocks.count() <= BROADCAST_BLOCKS:
        own = F.broadcast(own)
    rows = rows.join(own, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).drop("s", "b")
    inside = Window.partitionBy("source", "block").orderBy("order", "key", "size", "mark")
    cut = rows.where("room is not null").withColumn("until", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    keep = F.col("until") - F.col("size") / 2 <= F.col("room")
    cut = cut.withColumn("draws", F.when(keep, F.col("copies")).otherwise(F.slice("copies", F.lit(1), F.col("passes").cast("int"))))
    whole = rows.where("room is null").withColumn("draws", F.col("copies"))
    return whole.unionByName(cut.drop("until"))


def plan(docs: DataFrame, mix: Mix = Mix(), key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Per row: ``key``, ``source``, ``size``, ``source_size``, ``target``, and ``draws``.

    ``draws`` lists the shards that take the row, one entry per time taken.
    """
    sized = write_once(_blocked(sizes(docs, key, source, text), mix), "mix-sizes")
    return _drawn(sized, block_draws(sized, mix)).select("key", "source", "size", "source_size", "target", "draws")


def mix_documents(docs: DataFrame, mix: Mix = Mix(), key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken, by shard, shuffled inside.

    Rows come with all columns of ``docs`` and, unless they have one, ``mix_shard``.
    """
    sized = write_once(_blocked(sizes(docs, key, source, text), mix), "mix-sizes")
    rows = _drawn(_blocked(sizes(docs, key, source, text, carry=True), mix), block_draws(sized, mix))
    taken = rows.select("row", "order", "mark", F.posexplode("draws").alias("copy", "shard"))
    place = F.xxhash64(F.lit(mix.seed), "shard", "copy", "order", "mark")
    mixed = taken.withColumn("place", place).repartition("shard", F.pmod("place", F.lit(_PARTS))).sortWithinPartitions("shard", "place")
    return mixed.select("row.*", *([] if "mix_shard" in docs.columns else [F.col("shard").alias("mix_shard")]))
