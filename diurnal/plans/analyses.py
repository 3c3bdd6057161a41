"""Analyses that combine operators: typed areas, person panels, flows, map layers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nulls
from ..functions.composition import GROUPS, day_night_flag, entropy
from ..functions.text import cross_label, earning_bounds, metro_slug, parse_number
from ..operators import joins, order, reshape
from ..session import measured, settle

# Detailed label -> coarse band, per dimension.
AGE_BANDS = {
    "16_24": ["16 and 17 years", "18 to 20 years", "18 to 24 years", "21 to 24 years"],
    "25_44": ["25 to 34 years", "25 to 44 years", "35 to 44 years"],
    "45_64": ["45 to 59 years", "60 to 64 years"],
    "65_or_older": ["65 to 74 years", "75 years and over"],
}
LANGUAGE_BANDS = {"eng": ["Speak only English"], "span": ["Spanish"]}
POVERTY_BANDS = {
    "below_100_pct_pov": ["Below 100 percent of the poverty level"],
    "100_149_pct_pov": ["100 to 149 percent of the poverty level"],
    "150_pct_plus_pov": ["At or above 150 percent of the poverty level"],
}


def band_of(column: str, bands: Mapping[str, Sequence[str]], other: str | None = None) -> Column:
    """Coarse band of a detailed label; unlisted labels become ``other``."""
    out = None
    for name, labels in bands.items():
        hit = F.col(column).isin(*labels)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(other))


# Dimension -> its count columns.
DIVERSITY = {
    "age": ["tot_age_16_24", "tot_age_25_44", "tot_age_45_64", "tot_age_65_or_older"],
    "sex": ["tot_sex_male", "tot_sex_female"],
    "lang": ["tot_lang_eng", "tot_lang_span", "tot_lang_oth"],
    "inc": ["tot_below_100_pct_pov", "tot_100_149_pct_pov", "tot_150_pct_plus_pov"],
}


def with_entropy(units: DataFrame) -> DataFrame:
    """Residual shares clamped at 0, then race/ethnicity diversity by day and by night."""
    units = reshape.across(units, ["trt_shr_nho_am", "trt_shr_nho_pm"], nulls.at_least_zero)
    return units.withColumns(
        {f"race_eth_div_{s}": entropy([f"trt_shr_{g}_{s}" for g in GROUPS]) for s in ("am", "pm")}
    )


def add_day_night_flags(df: DataFrame) -> DataFrame:
    """Segregated / multiethnic flags by night and day and their crosses."""
    df = df.withColumns(
        {
            f"{name}_{side}": day_night_flag(f"{side}_cat", part, word, side)
            for side in ("am", "pm")
            for name, part, word in [
                ("predom", "Predominantly", "Segregated"),
                ("mult", "Multiethnic", "Multiethnic"),
            ]
        }
    )
    return df.withColumns({f"{n}_pm_am": cross_label(f"{n}_pm", f"{n}_am", ", ") for n in ("predom", "mult")})


def multidim_diversity(d: DataFrame, unit: str = "unit_id") -> DataFrame:
    """Normalized diversity by dimension at night and by day, and the change, per area.

    Areas known on one side of the day only drop out.
    """
    workers = F.col("tot_sex_male") + F.col("tot_sex_female")
    d = d.withColumns(
        {
            f"{name}_div": entropy([nulls.ratio(c, workers) for c in parts]) / F.ln(F.lit(float(len(parts)))) * 100
            for name, parts in DIVERSITY.items()
        }
    )
    pick = lambda kind, c: F.max(F.when(F.col("type") == kind, F.col(c)))
    both = (
        d.groupBy(unit)
        .agg(
            *[pick(k, f"{n}_div").alias(f"{k}_{n}_div") for n in DIVERSITY for k in ("res", "pow")],
            F.count_distinct("type").alias("_kinds"),
        )
        .filter(F.col("_kinds") == 2)
        .drop("_kinds")
    )
    return both.withColumns({f"chg_{n}_div": F.col(f"pow_{n}_div") - F.col(f"res_{n}_div") for n in DIVERSITY})


# Earnings bands.
EARN_BANDS = ["0_24999", "25000_49999", "50000_74999", "75000_or_more"]
EARN_SHARES = [f"shr_earn_{b}" for b in EARN_BANDS]


def add_earnings_diversity(wide: DataFrame) -> DataFrame:
    """Total workers, shares by band and their diversity; a missing band makes them NULL."""
    wide = wide.withColumn("tot_workers", sum((F.col(f"earn_{b}") for b in EARN_BANDS[1:]), F.col(f"earn_{EARN_BANDS[0]}")))
    wide = wide.withColumns({f"shr_earn_{b}": nulls.ratio(f"earn_{b}", "tot_workers") for b in EARN_BANDS})
    return wide.withColumn("earn_div", entropy(EARN_SHARES))


def earnings_profile(rows: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Workers by earnings band, wide, from labelled counts."""
    used = rows.filter(~F.col("earnings_str").contains("Total")).select(
        *ids, earning_bounds("earnings_str")["band"].alias("band"), parse_number("value").alias("value")
    )
    wide = reshape.widen(
        used.groupBy(*ids, "band").agg(nulls.sum_or_zero("value").alias("total")),
        ids,
        "band",
        EARN_BANDS,
        ["total"],
        template="earn_{level}",
    )
    return add_earnings_diversity(wide)


def race_eth() -> Column:
    """Race/ethnicity label of a person record from its two codes, first match first."""
    race, none = F.col("race"), F.col("hispan") == 0
    return (
        F.when((race == 1) & none, "NL White")
        .when((race == 2) & none, "NL Black")
        .when(race.between(4, 6) & none, "NL Asian/PI")
        .when(F.col("hispan").between(1, 4), "Latino")
        .otherwise("NL Other")
    )


# Survey year of the microdata -> period label.
MICRODATA_PERIODS = {2000: "2000", 2010: "2006-2010 ACS", 2016: "2012-2016 ACS"}


def person_panel(persons: DataFrame, keep: Column | None = None) -> DataFrame:
    """Metro by period by group panel of weighted estimates, shares and ratios to white.

    ``keep`` is an optional condition on the income, for codes that mean 'not applicable'.
    """
    keys, race = ["met_id", "year"], "race_eth"
    yr = F.col("yr")
    first, *rest = MICRODATA_PERIODS.items()
    year = F.when(yr == first[0], first[1])
    for code, label in rest:
        year = year.when(yr == code, label)
    p = persons.filter(F.col("met_id") != 0).withColumns({race: race_eth(), "year": year})
    abroad = ~F.coalesce(F.col("bpl").between(1, 99), F.lit(False))
    sums = p.groupBy(*keys, race).agg(
        F.sum("perwt").cast("bigint").alias("tot_pop"),
        nulls.weight_where(abroad, "perwt").cast("bigint").alias("tot_for_born"),
        nulls.weighted_avg("occscore", "perwt").alias("mean_occ_inc_score"),
        nulls.weighted_avg("sei", "perwt").alias("mean_sei"),
    )
    incomes = p if keep is None else p.filter(keep)
    med = order.weighted_medians(incomes, [*keys, race], "hhincome", "hhwt", "med_hh_inc")
    est = joins.natural_join(sums, med, "left", [*keys, race])
    est = reshape.shares_of_total(est, keys, "tot_pop", "pop_shr", "_all", spread=[race]).drop("_all")
    est = est.withColumn("shr_for_born", nulls.ratio("tot_for_born", "tot_pop"))
    ratios = {"inc_ratio": "med_hh_inc", "occ_score_ratio": "mean_occ_inc_score", "sei_ratio": "mean_sei"}
    return reshape.ratio_to_reference(est, keys, race, "NL White", ratios)


# Worker group columns of the flow tables and their labels.
FLOW_LABELS = {
    "nhw_est": "Workers who are Non-Hispanic Whites",
    "oth_est": "Workers who are not Non-Hispanic Whites",
}


def od_flows(
    flows: DataFrame,
    ends: DataFrame,
    home_types: DataFrame,
    work_types: DataFrame,
    key: str = "id",
    least: float = 1.0,
) -> DataFrame:
    """Flows whose two ends lie in the same metro, long by worker group, with both ends' attributes.

    ``ends`` has one row per place: its id, its ``metro_id`` and whatever else to attach (say
    coordinates); leave only one metro's places in it for the flows of that metro.
    ``home_types`` and ``work_types`` carry the types of each end; flows to places without a
    work type are dropped, as are values below ``least``.
    """
    home, work = f"res_{key}", f"pow_{key}"
    # types join the places first, so that the flows meet one table per end
    home_ends, home_size = measured(joins.natural_join(joins.prefixed(ends, "res_"), home_types, "left", [home]))
    work_ends, work_size = measured(joins.natural_join(joins.prefixed(ends, "pow_"), work_types, "inner", [work]))
    # the metros alone come first, so that only flows inside one are repeated for the rows of their ends
    flows = settle(flows.drop("total_est"))
    home_metros = home_ends.filter(F.col("res_metro_id").isNotNull()).select(home, "res_metro_id").distinct()
    placed = joins.attach(flows, home_metros, [home], [work], "inner", counted=flows)
    same_metro = F.col("res_metro_id") == F.col("pow_metro_id")
    work_metros = work_ends.select(work, "pow_metro_id").distinct()
    inside = settle(joins.attach(placed, work_metros, [work], [home], "left_semi", same_metro, counted=flows))
    inside = inside.withColumn("pow_metro_id", F.col("res_metro_id"))
    placed = joins.attach(inside, home_ends, [home, "res_metro_id"], [work], "inner", size=home_size)
    typed = joins.attach(placed, work_ends, [work, "pow_metro_id"], [home], "inner", size=work_size, counted=inside)
    typed = typed.select(*flows.columns, *[c for c in home_ends.columns if c != home], *[c for c in work_ends.columns if c != work])
    ids = [c for c in typed.columns if c not in FLOW_LABELS]
    long = typed.unpivot(ids, list(FLOW_LABELS), "name", "value").filter(F.col("value") >= least)
    label = F.when(F.col("name") == "nhw_est", FLOW_LABELS["nhw_est"]).otherwise(FLOW_LABELS["oth_est"])
    return long.withColumn("est_type", label)


def metro_layers(
    units: DataFrame, top: int, base: str = "2000", last: str = "2012-2016 ACS"
) -> DataFrame:
    """Flags, slug and largest principal place for every area of the largest metros.

    One table keyed by metro; writing it partitioned by slug gives one layer per metro.
    """
    totals = units.filter(F.col("year") == last).groupBy("metro_id").agg(nulls.sum_or_zero("trt_tot_pop").alias("metro_pop"))
    largest = order.top_with_ties(totals, top, "metro_pop").select("metro_id")
    rows = joins.keep_matching(units.filter(F.col("year").isin(base, last)), largest, ["metro_id"], ["unit_id"])
    rows = settle(rows)
    rows = add_day_night_flags(rows).withColumn("slug", metro_slug("metro_name"))
    by_place = (
        rows.filter(F.col("prin_city")).groupBy("metro_id", "place_name").agg(nulls.sum_or_zero("trt_tot_pop").alias("place_pop"))
    )
    main = order.top_with_ties(by_place, 1, "place_pop", ["metro_id"], ["place_name"]).select(
        "metro_id", "place_name", F.lit(True).alias("in_largest_place")
    )
    marked = joins.attach(rows, main, ["metro_id", "place_name"], ["unit_id"])
    return marked.withColumn("in_largest_place", F.coalesce("in_largest_place", F.lit(False)))
