"""Segregation, diversity and change measures of areas and metros."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.composition import GROUPS, change_columns, entropy, share_columns, total
from ..functions.nulls import (
    as_col,
    group_constant,
    ratio,
    strict_avg,
    strict_sum,
    subset_avg,
    sum_or_zero,
)
from ..session import settle
from .joins import attach, category_grid, complete_grid, keep_matching, natural_join
from .reshape import shares_of_total

Pair = tuple[str, str]


def add_composition(units: DataFrame) -> DataFrame:
    """Night and day shares of every group and their differences."""
    return units.withColumns({**share_columns("pm"), **share_columns("am")}).withColumns(
        change_columns()
    )


def dissimilarity(
    units: DataFrame, keys: Sequence[str], pairs: Mapping[str, Pair], spread: Sequence[str]
) -> DataFrame:
    """D = 1/2 sum |a/A - b/B| per group of areas, one column per pair of counts.

    Two passes of partial aggregation: group totals, then the sum of differences. A missing
    count, or a group without any member, makes D NULL.
    """
    counts = sorted({c for pair in pairs.values() for c in pair})
    sums = units.groupBy(*keys).agg(*[strict_sum(c).alias(f"_{c}") for c in counts])
    joined = attach(units.select(*{*keys, *counts, *spread}), sums, keys, spread)
    gap = lambda a, b: F.abs(ratio(a, f"_{a}") - ratio(b, f"_{b}"))
    return joined.groupBy(*keys).agg(
        *[(0.5 * strict_sum(gap(a, b))).alias(name) for name, (a, b) in pairs.items()]
    )


def add_dissimilarity(
    units: DataFrame, keys: Sequence[str], pairs: Mapping[str, Pair], spread: Sequence[str]
) -> DataFrame:
    """Attach each group's D to all of its areas."""
    return attach(units, dissimilarity(units, keys, pairs, spread), keys, spread)


def dissimilarity_summary(
    units: DataFrame,
    metro: str,
    unit: str,
    sides: Mapping[str, str],
    minorities: Mapping[str, str],
    majority: str = "nhw",
) -> DataFrame:
    """D, members and population per period, metro, pair of groups and side of the day.

    ``sides`` maps a label to a count prefix, ``minorities`` a label to a group. Areas missing a
    count of a pair are left out of that pair. All pairs are computed side by side in two
    aggregations of the wide rows, and become rows only in the small result.
    """
    keys = ["year", metro, "metro_name"]
    combos = [(seg, side, f"{p}_{g}_est", f"{p}_{majority}_est", f"{p}_total_est")
              for side, p in sides.items() for seg, g in minorities.items()]

    def used(i: int) -> Column:
        _, _, a, b, _ = combos[i]
        return F.col(a).isNotNull() & F.col(b).isNotNull()

    by_unit = units.groupBy(*keys, unit).agg(
        *[
            c
            for i, (_, _, a, b, pop) in enumerate(combos)
            for c in (
                F.max(F.when(used(i), 1).otherwise(0)).alias(f"n{i}"),
                F.sum(F.when(used(i), F.col(a))).alias(f"a{i}"),
                F.sum(F.when(used(i), F.col(b))).alias(f"b{i}"),
                F.sum(F.when(used(i), F.col(pop))).alias(f"p{i}"),
                F.max(F.when(used(i) & F.col(pop).isNull(), 1).otherwise(0)).alias(f"q{i}"),
            )
        ]
    )
    sums = settle(
        by_unit.groupBy(*keys).agg(
            *[F.sum(f"{c}{i}").alias(f"{c}{i}") for c in "nab" for i in range(len(combos))],
            *[F.when(F.max(f"q{i}") == 0, F.sum(f"p{i}")).alias(f"p{i}") for i in range(len(combos))],
        )
    )
    counts = sorted({c for combo in combos for c in combo[2:4]})
    joined = attach(units.select(*keys, unit, *counts), sums, keys, [unit])

    def index(i: int) -> Column:
        _, _, a, b, _ = combos[i]
        gap = F.abs(ratio(a, f"a{i}") - ratio(b, f"b{i}"))
        return F.when(
            F.count_if(used(i)) == F.count(F.when(used(i), gap)), 0.5 * F.sum(F.when(used(i), gap))
        ).alias(f"d{i}")

    d = joined.groupBy(*keys).agg(*[index(i) for i in range(len(combos))])
    rows = F.array(
        *[
            F.struct(
                F.lit(seg).alias("seg"),
                F.lit(side).alias("type"),
                F.col(f"n{i}").alias("metro_n"),
                F.col(f"a{i}").alias("metro_group"),
                F.col(f"p{i}").alias("metro_pop"),
                F.col(f"d{i}").alias("dis"),
            )
            for i, (seg, side, *_) in enumerate(combos)
        ]
    )
    wide = natural_join(sums, d, "left", keys)
    return wide.select(*keys, F.inline(rows)).filter(F.col("metro_n") > 0)


def information_index(counts: Sequence[str]) -> Column:
    """Multigroup information index H as one aggregate expression.

    sum t_i (E - E_i) / (T E) equals 1 - sum(t_i E_i) / (T E), and E needs only group sums,
    so areas are read once and nothing is joined back.
    """
    here = total(counts)
    local = here * entropy([F.coalesce(ratio(c, here), F.lit(0.0)) for c in counts])
    whole = strict_sum(here)
    overall = entropy([ratio(strict_sum(c), whole) for c in counts])
    return 1 - F.try_divide(strict_sum(local), F.nullif(whole * overall, F.lit(0.0)))


def isolation(minority: Column | str, majority: Column | str) -> Column:
    """Chance that a member meets a member: sum (x_i / X)(x_i / (x_i + y_i))."""
    x, y = as_col(minority), as_col(majority)
    met = F.when(x + y == 0, F.lit(0.0)).otherwise(x * ratio(x, x + y))
    return F.try_divide(strict_sum(met), strict_sum(x))


def transition_matrix(units: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Counts and shares of ``end`` types within (keys, start type), on the full grid.

    Combinations that do not occur have n = 0 and shr = 0; ``total`` is the row's count.
    """
    within = [*keys, start]
    counts = settle(units.groupBy(*within, end).agg(F.count(F.lit(1)).alias("n")))
    shares = shares_of_total(counts, within, "n", spread=[end]).drop("total")
    grid = category_grid(counts, [*within, end])
    full = complete_grid(shares, grid, {"n": 0, "shr": 0.0})
    totals = full.groupBy(*within).agg(F.sum("n").alias("total"))
    return natural_join(full, totals, "left", within)


def qualifying_groups(
    units: DataFrame, key: str, thresholds: Mapping[str, float]
) -> DataFrame:
    """Per group and threshold the group's id if its total reaches it, else NULL."""
    return units.groupBy(key).agg(
        *[
            F.when(sum_or_zero(c) >= least, F.col(key)).alias(f"ok_{c}")
            for c, least in thresholds.items()
        ]
    )


def eligible_units(
    units: DataFrame,
    metro: str,
    unit: str,
    thresholds: Mapping[str, float],
    base_period: str = "2000",
) -> DataFrame:
    """Areas with people by day and by night in metros that met every threshold at first."""
    peopled = units.filter((F.col("res_total_est") > 0) & (F.col("pow_total_est") > 0))
    flags = qualifying_groups(peopled.filter(F.col("year") == base_period), metro, thresholds)
    good = flags.dropna(subset=[f"ok_{c}" for c in thresholds]).select(metro)
    shares = [f"trt_shr_{g}_am" for g in ("nhw", "nhb", "nha", "h")]
    return keep_matching(peopled.dropna(subset=shares), good, [metro], [unit])


def reallocate(
    counts: DataFrame,
    crosswalk: DataFrame,
    unit: str,
    source: str,
    target: str,
    weight: str,
    measures: Sequence[str],
    keys: Sequence[str] = ("year",),
) -> DataFrame:
    """Move counts to other boundaries: sum of count * weight per target area.

    Counts are folded to one row per source area before the join, which changes nothing in a
    weighted sum and keeps a heavily repeated area from multiplying. Areas without a target
    are dropped; a missing count or weight makes the target's value NULL.
    """
    folded = counts.groupBy(*keys, unit).agg(*[strict_sum(m).alias(m) for m in measures])
    bridge = crosswalk.select(
        F.col(source).alias(unit), F.col(target).alias("_to"), F.col(weight).alias("_weight")
    ).filter(F.col("_to").isNotNull())
    moved = natural_join(folded, bridge, "inner", [unit])
    return (
        moved.groupBy(*keys, "_to")
        .agg(*[strict_sum(F.col(m) * F.col("_weight")).alias(m) for m in measures])
        .withColumnRenamed("_to", unit)
    )


def metro_panel(units: DataFrame, keys: Sequence[str], day_group: str = "Multiethnic") -> DataFrame:
    """Metro-by-period panel of diversity, segregation, totals and changes.

    Everything but the medians and the spatial indices comes from one aggregation.
    """
    minority = total([f"res_{g}_est" for g in ("nhb", "nha", "h", "nho")])
    city = F.col("prin_city")
    div = {"whood": F.col("race_eth_div_am"), "nhood": F.col("race_eth_div_pm")}
    cat = {"whood": "am_cat", "nhood": "pm_cat"}
    aggs = [F.count(F.lit(1)).alias("n_tract")]
    for name, d in div.items():
        aggs += [
            strict_avg(d).alias(f"avg_div_{name}"),
            subset_avg(d, city).alias(f"avg_div_{name}_city"),
            subset_avg(d, ~city).alias(f"avg_div_{name}_sub"),
            F.count_if(F.col(cat[name]) == day_group).alias(f"n_div_{name}"),
        ]
    aggs += [
        information_index([f"res_{g}_est" for g in ("nha", "nhb", "h", "nhw")]).alias(
            "multi_theil_nhood"
        ),
        isolation(minority, "res_nhw_est").alias("iso_nhood"),
        F.max("state").alias("state"),
        strict_sum("res_total_est").alias("tot_pop"),
        F.log10(strict_sum("res_total_est")).alias("log_pop"),
        *[strict_sum(f"res_{g}_est").alias(f"tot_{g}") for g in GROUPS],
        sum_or_zero(F.when(~city, F.col("res_total_est"))).alias("tot_suburb"),
        *[strict_avg(f"chg_{g}").alias(f"avg_chg_{g}") for g in ("nhw", "nhb", "nha", "h")],
    ]
    if "trt_tot_for_born" in units.columns:
        aggs.append(strict_sum("trt_tot_for_born").alias("tot_for_born"))
    aggs += [
        group_constant(c).alias(c)
        for c in ("dis_nhb_nhw", "dis_h_nhw", "dis_nha_nhw")
        if c in units.columns
    ]
    panel = units.groupBy(*keys).agg(*aggs)
    parts = [c for c in panel.columns if c.startswith("tot_") and c != "tot_pop"]
    names = {"tot_suburb": "met_shr_sub"}
    return panel.withColumns(
        {
            **{names.get(c, c.replace("tot_", "met_shr_")): ratio(c, "tot_pop") for c in parts},
            **{f"shr_div_{k}": ratio(f"n_div_{k}", "n_tract") for k in div},
            **{f"shr_non_div_{k}": 1 - ratio(f"n_div_{k}", "n_tract") for k in div},
        }
    )
