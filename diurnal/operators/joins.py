"""Joins in which NULL keys match each other and hot keys are spread out.

A side is broadcast only if its size in memory, counted when it was written, is within
``spark.sql.autoBroadcastJoinThreshold``; anything larger is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_limit, measured, settle

_SALT, _HASH, _PARTS = "_salt", "_key_hash", "_parts"
#: A key is hot if more than one row in so many has it; each part of a hot key holds about as many rows.
HOT_PART = 1000
#: Keys a sketch tracks. It misses a key's count by at most 3.5 rows in so many.
TRACKED = 20_000


def shared_columns(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in right.columns]


def natural_join(
    left: DataFrame,
    right: DataFrame,
    how: str = "left",
    on: Sequence[str] | None = None,
    where: Column | None = None,
) -> DataFrame:
    """Join on all shared columns (or ``on``), a NULL key matching a NULL key."""
    on = list(on) if on is not None else shared_columns(left, right)
    return renamed_key_join(left, right, {c: c for c in on}, how, where)


def renamed_key_join(
    left: DataFrame,
    right: DataFrame,
    keys: Mapping[str, str],
    how: str = "left",
    where: Column | None = None,
) -> DataFrame:
    """Join on ``{left column: right column}``; the right key columns are dropped."""
    theirs = {r: f"_right_{r}" for r in keys.values()}
    right = right.withColumnsRenamed(theirs)
    match = reduce(and_, [F.col(l).eqNullSafe(F.col(theirs[r])) for l, r in keys.items()])
    joined = left.join(right, match if where is None else match & where, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*theirs.values())


def hot_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hash of every key that more than one row in ``HOT_PART`` has, and the parts to deal its rows to.

    A frequent-items sketch of the hashes is filled in every task and merged, in one pass over the key
    columns. At most ``HOT_PART`` keys can be hot, so the result is a bounded local table. Two
    keys with one hash are both dealt out, which changes no result.
    """
    spark = rows.sparkSession
    hashed = rows.select(F.xxhash64(*keys).alias("h"))
    top = F.expr(f"approx_top_k(h, {2 * HOT_PART}, {TRACKED})")
    found = hashed.agg(F.count(F.lit(1)).alias("n"), top.alias("top")).first()
    least = found["n"] / HOT_PART
    hot = [(x["item"], -(-x["count"] * HOT_PART // found["n"])) for x in found["top"] or [] if x["count"] > max(least, 1)]
    return spark.createDataFrame(hot, f"{_HASH} long, {_PARTS} long")


def salted(df: DataFrame, keys: Sequence[str], hot: DataFrame, spread: Sequence[str] | None = None) -> DataFrame:
    """Rows with a salt: 0 for cold keys, one of its parts for a hot key, by a hash of ``spread``.

    Without ``spread`` a row of a hot key is repeated for all its parts.
    """
    entries = ", ".join(f"{r[_HASH]}L, {r[_PARTS]}L" for r in hot.collect())  # a bounded local table
    parts = F.coalesce(F.try_element_at(F.expr(f"cast(map({entries}) as map<bigint, bigint>)"), F.xxhash64(*keys)), F.lit(1).cast("bigint"))
    if spread is None:
        return df.withColumn(_SALT, F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
    return df.withColumn(_SALT, F.pmod(F.xxhash64(*spread), parts))


def attach(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    how: str = "left",
    where: Column | None = None,
    size: int | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Join a table of groups to many rows per group.

    The table is written and measured, unless ``size`` says what a table that is written already holds in memory. If it may be broadcast, the rows are not
    shuffled at all. Otherwise hot keys are looked for in the rows. Their rows are dealt to parts
    by a hash of the ``spread`` columns, and only their groups are copied, once for each part, so
    a key holding a third of all rows does not sit in one task, and the table stays about as large
    as it is. The salt is a hash, not a random number: a recomputed task
    gives the same rows. ``where`` is a further condition of the match. ``counted`` is a written table in which
    keys are about as frequent as in the rows: hot keys are looked for there, and the rows are computed once.

    For a table about as large as the rows use ``natural_join``, which is left to the
    skew handling of adaptive execution.
    """
    if size is None:
        table, size = measured(table)
    if size <= broadcast_limit(rows.sparkSession):
        return natural_join(rows, F.broadcast(table), how, keys, where)
    hot = hot_keys(rows if counted is None else counted, keys)
    # the hint keeps Catalyst from broadcasting by the size of the compressed files
    copies = salted(table, keys, hot).hint("merge")
    return natural_join(salted(rows, keys, hot, spread), copies, how, [*keys, _SALT], where).drop(_SALT)


def join_all(tables: Sequence[DataFrame], on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join several tables on one set of identifiers, NULL ids matching NULL ids.

    For tables with one row per id that are all made from one source, ``reshape.widen_sums`` gives the
    same result in one shuffle.
    """
    return reduce(lambda a, b: natural_join(a, b, how, on), tables)


def keep_matching(rows: DataFrame, table: DataFrame, keys: Sequence[str], spread: Sequence[str]) -> DataFrame:
    """Rows whose keys occur in the table."""
    return attach(rows, table.select(*keys).distinct(), keys, spread, "left_semi")


def unmatched_counts(rows: DataFrame, table: DataFrame, key: str, report: Sequence[str]) -> DataFrame:
    """How many rows have no partner, by the ``report`` columns."""
    return natural_join(rows, table.select(key).distinct(), "left_anti", [key]).groupBy(*report).agg(
        F.count(F.lit(1)).alias("n")
    )


def category_grid(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every combination of the labels found in category columns.

    The distinct labels of each column are aggregated apart (the category columns have a
    handful of labels each) and set beside the rows so far as one array, which is exploded. Between
    columns the rows are dealt out anew, so the product is not made in one task.
    """
    grid = df.select(columns[0]).distinct()
    for c in columns[1:]:
        labels = df.select(F.struct(c).alias(c)).distinct().agg(F.collect_list(c).alias(c))
        grid = grid.repartition(*grid.columns).withColumn(c, labels.scalar()).withColumn(c, F.explode(c))
        grid = grid.withColumn(c, F.col(c)[c])
    return grid


def complete_grid(
    counts: DataFrame, grid: DataFrame, fill: Mapping[str, Column | float | int]
) -> DataFrame:
    """Counts on the full grid, combinations without a row filled in."""
    full = natural_join(grid, counts, "left", grid.columns)
    return full.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items()})


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.toDF(*[f"{prefix}{c}" for c in df.columns])


def join_both_ends(
    flows: DataFrame,
    places: DataFrame,
    key: str,
    origin: str = "res_",
    destination: str = "pow_",
    how: str = "left",
) -> DataFrame:
    """Attach one table of places to the home end and to the work end of every flow.

    Each end is spread by the id of the other end: one big work place does not gather all
    of its flows in one task. Flows are written first, if they are to be shuffled: hot keys of both ends are
    counted there.
    """
    places, size = measured(places)  # read once for each end
    written = flows if size <= broadcast_limit(flows.sparkSession) else settle(flows)
    flows = written
    ends = {origin: destination, destination: origin}
    for here, there in ends.items():
        flows = attach(flows, prefixed(places, here), [here + key], [there + key], how, size=size, counted=written)
    return flows
