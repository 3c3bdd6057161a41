"""Ranks, quantiles and running totals that never gather a whole group in one task.

A window over a group sorts that group in a single task. The operators here first fold
equal values (with partial aggregation), cut the folded rows of larger groups into ranges of (group, value) of
about ``BIN_ROWS`` rows, and run windows only inside a range and over the ranges. The number
of ranges grows with the rows, so a window is bounded whatever a group holds. Results are
exact: sampling decides where the cuts are, not what is counted.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .joins import attach, natural_join

BIN_ROWS = 200_000  # folded rows of one range, about
_ALL = "_all"


def _with_key(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """A constant key stands in for 'no keys'."""
    if keys:
        return df, list(keys)
    return df.withColumn(_ALL, F.lit(1)), [_ALL]


def _before(c: str, w) -> Column:
    return F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _ranges(
    df: DataFrame, keys: Sequence[str], by: Sequence[str], weight: str | None, bin_rows: int = BIN_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Folded rows with the ``_bin`` they lie in, and one row per (keys, ``_bin``) with totals.

    Only groups of more than ``bin_rows`` folded rows are cut; any other is a range by itself.

    The second table has the known rows and weights in the bin (``_n``, ``_w``), those of the
    group before it (``_n_start``, ``_w_start``), and of the whole group (``_n_all``, ``_w_all``,
    ``_n_null``). Its windows see one row per range of a group.
    """
    value = by[0]
    tally = settle(
        df.groupBy(*keys, *by)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_w", F.col("_n") * (F.col(weight) if weight else F.lit(1)))
    )
    whole = lambda rows: rows.withColumn("_bin", F.lit(0))
    large = settle(tally.groupBy(*keys).count().filter(F.col("count") > bin_rows)) if tally.count() > bin_rows else None
    if large is None or large.isEmpty():
        binned = whole(tally)
    else:
        parts = -(-large.agg(F.sum("count")).first()[0] // bin_rows)
        cut = attach(tally, large.select(*keys), keys, by, "left_semi")
        dealt = cut.repartitionByRange(parts, *keys, *by)
        cut = settle(dealt.withColumn("_bin", F.spark_partition_id()))
        binned = cut.unionByName(whole(attach(tally, large.select(*keys), keys, by, "left_anti")))
    known = F.col(value).isNotNull()
    totals = binned.groupBy(*keys, "_bin").agg(
        F.sum(F.when(known, F.col("_n"))).alias("_n"),
        F.sum(F.when(known, F.col("_w"))).alias("_w"),
        F.sum(F.when(~known, F.col("_n")).otherwise(0)).alias("_null"),
    )
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_bin")
    return binned.filter(known), totals.select(
        *keys,
        "_bin",
        "_n",
        "_w",
        _before("_n", earlier).alias("_n_start"),
        _before("_w", earlier).alias("_w_start"),
        F.sum("_n").over(group).alias("_n_all"),
        F.sum("_w").over(group).alias("_w_all"),
        F.sum("_null").over(group).alias("_n_null"),
    )


def _inside(known: DataFrame, totals: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Rows of the ranges in ``totals`` with what lies before them in their group."""
    own = totals.drop("_n", "_w")
    out = natural_join(known, own, "inner", [*keys, "_bin"])
    in_bin = Window.partitionBy(*keys, "_bin").orderBy(*by)
    return out.withColumns(
        {
            "_n_before": F.col("_n_start") + _before("_n", in_bin),
            "_w_before": F.col("_w_start") + _before("_w", in_bin),
        }
    ).drop("_bin", "_n_start", "_w_start")


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    weight: str | None = None,
    bin_rows: int = BIN_ROWS,
) -> DataFrame:
    """One row per (keys, value, weight) with what lies before it in its group.

    Columns added: ``_n`` equal rows, ``_n_before`` rows with a smaller value (or an equal
    value and a smaller weight), ``_n_all`` rows in the group, the same for the weights as
    ``_w``, ``_w_before``, ``_w_all``, and ``_n_null`` rows of the group without a value. A group
    in which no row has a value is left out.
    """
    df, keys = _with_key(df, keys)
    by = [value] if weight is None else [value, weight]
    known, totals = _ranges(df, keys, by, weight, bin_rows)
    return _inside(known, totals, keys, by).drop(_ALL)


def average_ranks(
    df: DataFrame, keys: Sequence[str], value: str, descending: bool = False, **options
) -> DataFrame:
    """Distinct (keys, value) with ``rank``, ties sharing the mean of their ranks."""
    t = running_totals(df, keys, value, **options)
    before = F.col("_n_all") - F.col("_n_before") - F.col("_n") if descending else F.col("_n_before")
    return t.select(*keys, value, (before + (F.col("_n") + 1) / 2).alias("rank"))


def add_rank(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    out: str,
    descending: bool = False,
    **options,
) -> DataFrame:
    """Add the average-tie rank to every row; a NULL value has a NULL rank."""
    ranks = average_ranks(df, keys, value, descending, **options).withColumnRenamed("rank", out)
    return natural_join(df, ranks, "left", [*keys, value])


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    strict: bool = False,
    **options,
) -> DataFrame:
    """Exact interpolated quantiles, one column per entry of ``probs``.

    With ``strict`` a NULL in the group makes its quantiles NULL. Only the ranges that hold a
    wanted position are sorted. A group in which no row has a value is left out.
    """
    df, all_keys = _with_key(df, keys)
    known, totals = _ranges(df, all_keys, [value], None, **options)
    h = {p: (F.col("_n_all") - 1) * F.lit(p) for p in probs.values()}
    ends = [f(x) for x in h.values() for f in (F.floor, F.ceil)]
    holds = [(F.col("_n_start") <= e) & (e < F.col("_n_start") + F.col("_n")) for e in ends]
    t = _inside(known, totals.filter(reduce(or_, holds)), all_keys, [value])
    unknown = F.max("_n_null") > 0 if strict else F.lit(False)

    def at(position: Column) -> Column:
        inside = (F.col("_n_before") <= position) & (position < F.col("_n_before") + F.col("_n"))
        return F.max(F.when(inside, F.col(value).cast("double")))

    def quantile(p: float) -> Column:
        low, high = at(F.floor(h[p])), at(F.ceil(h[p]))
        return F.when(~unknown, low + (high - low) * F.max(h[p] - F.floor(h[p])))

    return t.groupBy(*keys).agg(*[quantile(p).alias(name) for name, p in probs.items()])


def medians(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], prefix: str = "", **options
) -> DataFrame:
    """Exact medians of several columns, found in one pass over (column, value) rows.

    A NULL in a column makes its median NULL.
    """
    long = df.unpivot(list(keys), list(columns), "_measure", "_value")
    found = quantiles(long, [*keys, "_measure"], "_value", {"_median": 0.5}, strict=True, **options)
    return found.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("_measure") == c, F.col("_median"))).alias(f"{prefix}{c}")
            for c in columns
        ]
    )


def weighted_medians(
    df: DataFrame, keys: Sequence[str], value: str, weight: str, out: str, **options
) -> DataFrame:
    """Interpolated weighted median per group.

    Rows in the order of (value, weight) have midpoints c = (weight before) + weight / 2; the
    median is read off at half of the total weight. Rows without positive weight are left
    out; a NULL value makes the result NULL.
    """
    t = running_totals(df.filter(F.col(weight) > 0), keys, value, weight, **options)
    w, n, start = F.col(weight), F.col("_n"), F.col("_w_before")
    first = start + w / 2
    last = first + (n - 1) * w
    half = F.col("_w_all") / 2
    steps = F.floor((half - first) / w)
    below = F.when(first <= half, F.least(first + steps * w, last))
    above = F.when(first > half, first).when(last > half, first + (steps + 1) * w)
    point = lambda c: F.struct(c.alias("c"), F.col(value).cast("double").alias("x"))
    ends = t.groupBy(*keys).agg(
        F.max(F.when(below.isNotNull(), point(below))).alias("lo"),
        F.min(F.when(above.isNotNull(), point(above))).alias("hi"),
        F.max(half).alias("half"),
        F.max("_n_null").alias("_n_null"),
    )
    between = F.col("lo.x") + (F.col("hi.x") - F.col("lo.x")) * (
        (F.col("half") - F.col("lo.c")) / (F.col("hi.c") - F.col("lo.c"))
    )
    median = (
        F.when(F.col("lo").isNull(), F.col("hi.x"))
        .when(F.col("hi").isNull(), F.col("lo.x"))
        .otherwise(between)
    )
    return ends.select(*keys, F.when(F.col("_n_null") == 0, median).alias(out))


def lowest_of_top(df: DataFrame, n: int, value: str, keys: Sequence[str]) -> DataFrame:
    """The smallest of the ``n`` largest values of each group, as ``_cut``."""
    order = Window.partitionBy(*keys).orderBy(F.desc(value))
    return (
        df.filter(F.col(value).isNotNull())
        .select(*keys, value, F.row_number().over(order).alias("_row"))
        .filter(F.col("_row") <= n)
        .groupBy(*keys)
        .agg(F.min(value).alias("_cut"))
    )


def top_with_ties(
    df: DataFrame, n: int, value: str, keys: Sequence[str] = (), spread: Sequence[str] | None = None
) -> DataFrame:
    """The rows of the ``n`` largest values, rows tied with the last one included.

    Only the cut-off is computed by ordering: each task keeps its own best ``n`` rows per
    group before anything is shuffled. Rows are then compared with the cut-off.
    """
    if not keys:
        best = df.filter(F.col(value).isNotNull()).select(value).orderBy(F.desc(value)).limit(n)
        return df.filter(F.col(value) >= best.agg(F.min(value)).scalar())
    cut = lowest_of_top(df, n, value, keys)
    marked = attach(df, cut, list(keys), spread or df.columns, "inner")
    return marked.filter(F.col(value) >= F.col("_cut")).drop("_cut")


def fill_down(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[Column | str],
    columns: Sequence[str],
    bin_rows: int = BIN_ROWS,
) -> DataFrame:
    """Fill NULLs with the last known value above them among the rows of a key.

    ``order`` gives the rows' order (put the period first, then what orders rows inside it);
    rows before the first known value stay NULL, and rows equal in it are filled alike. Rows are
    folded to one per key and place first, with the largest known value of equal rows. Filling is a segmented
    scan: places are cut into ranges, each range hands on the last value it knows, a window over
    the ranges of a key gives what comes into each, and inside a range values are carried on. No window
    holds more than a range, however long the history of a key is.
    """
    df, key = _with_key(df, key)
    place = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    placed = df.withColumn("_place", place)
    known = settle(placed.groupBy(*key, "_place").agg(*[F.max(c).alias(f"_{c}") for c in columns]))
    parts = -(-known.count() // bin_rows)
    if parts > 1:
        dealt = known.repartitionByRange(parts, *key, "_place")
        binned = settle(dealt.withColumn("_bin", F.spark_partition_id()))
    else:
        binned = known.withColumn("_bin", F.lit(0))
    handed = binned.groupBy(*key, "_bin").agg(
        *[F.max_by(f"_{c}", F.when(F.col(f"_{c}").isNotNull(), F.col("_place"))).alias(f"_out_{c}") for c in columns]
    )
    earlier = Window.partitionBy(*key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    coming = handed.select(
        *key, "_bin", *[F.last(f"_out_{c}", ignorenulls=True).over(earlier).alias(f"_in_{c}") for c in columns]
    )
    so_far = Window.partitionBy(*key, "_bin").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    inside = binned.select(
        *key, "_bin", "_place", *[F.last(f"_{c}", ignorenulls=True).over(so_far).alias(f"_{c}") for c in columns]
    )
    carried = natural_join(inside, coming, "left", [*key, "_bin"]).select(
        *key, "_place", *[F.coalesce(f"_{c}", f"_in_{c}").alias(f"_{c}") for c in columns]
    )
    joined = natural_join(placed, carried, "left", [*key, "_place"])
    return joined.withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop(
        "_place", _ALL, *[f"_{c}" for c in columns]
    )


def ordered_levels(df: DataFrame, label: str, measure: str, out: str = "ordinal") -> DataFrame:
    """Category labels numbered by the median of a measure (ties by label).

    The numbering window runs over the labels only, one row each.
    """
    by_label = medians(df, [label], [measure], "_med_")
    order = Window.orderBy(f"_med_{measure}", label)
    return by_label.select(label, F.row_number().over(order).alias(out))
