"""Queries: projection, filters, reshaping, stacking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.composition import GROUPS, PERIODS, TYPES_7
from ..functions.nulls import at_least_zero, ratio, rounded
from ..functions.text import cross_label, keep_label, percent_label, split_piece
from ..operators import reshape
from ..operators.order import ordered_levels
from ..operators.segregation import reallocate
from ..plans.builds import (
    INDICATOR_COUNTS,
    INDICATOR_SHARES,
    INDICATOR_YEARS,
    indicator_codes,
    tract_indicators,
)
from ..session import settle
from . import fixtures as fx
from .fixtures import r6, with_ctes
from .registry import query


@query(
    "prj_select_rename",
    with_ctes(
        "select unit_id as geoid, metro_id as cbsafp10, year, res_total_est, res_nhw_est, res_nhb_est, res_h_est, res_nha_est, res_nho_est, 'fixture' as source from f2",
        "f2",
    ),
)
def prj_select_rename(spark, sf):
    u = fx.units(spark, sf)
    counts = reshape.column_range(u, "res_total_est", "res_nho_est")
    return (
        u.drop("prin_city", "metro_name")
        .select("unit_id", "metro_id", "year", *counts)
        .withColumnsRenamed({"unit_id": "geoid", "metro_id": "cbsafp10"})
        .withColumn("source", F.lit("fixture"))
    )


@query(
    "prj_prefix_all",
    "select n_nationkey as res_nationkey, n_name as res_name, n_regionkey as res_regionkey from nation",
)
def prj_prefix_all(spark, sf):
    n = fx.table(spark, sf, "nation")
    return reshape.rename_all(n, lambda c: "res_" + c.lower().removeprefix("n_"))


@query(
    "prj_across",
    with_ctes(
        "select upper(metro_name) as metro_name, upper(state) as state, year, unit_id, "
        + ", ".join(f"{r6(f'res_{g}_est / 1e1')} as res_{g}_est" for g in GROUPS)
        + " from f2",
        "f2",
    ),
)
def prj_across(spark, sf):
    u = fx.units(spark, sf)
    night = [f"res_{g}_est" for g in GROUPS]
    u = reshape.across(u, reshape.text_columns(u, but=["year"]), F.upper)
    u = reshape.across(u, night, lambda c: rounded(c / 10.0))
    return u.select("metro_name", "state", "year", "unit_id", *night)


@query(
    "prj_null_to_zero",
    with_ctes(
        "select unit_id, year, coalesce(max(case when grp = 'nhb' and type = 'res' then est end), 0) as nhb_res, coalesce(max(case when grp = 'nhb' and type = 'pow' then est end), 0) as nhb_pow from f1 group by 1, 2",
        "f1",
    ),
)
def prj_null_to_zero(spark, sf):
    wide = reshape.widen(
        fx.unit_counts(spark, sf).filter(F.col("grp").isNotNull()).withColumn(
            "est", F.when(F.col("grp") == "nhb", F.col("est"))
        ),
        ["unit_id", "year"],
        "type",
        ["res", "pow"],
        ["est"],
        template="nhb_{level}",
    )
    return reshape.across(wide, ["nhb_res", "nhb_pow"], lambda c: F.coalesce(c, F.lit(0.0)))


@query(
    "flt_predicates",
    with_ctes(
        "select unit_id, year, state, metro_name, res_total_est from f2 where year in ('2000', '2012-2016 ACS') and state not in ('ASIA') and regexp_matches(metro_name, '[AI]') and not starts_with(metro_name, 'U') and trt_shr_nhw_pm is not null and res_total_est > 20".replace("f2", "sh"),
        "sh",
    ),
)
def flt_predicates(spark, sf):
    u = fx.composed(spark, sf)
    return u.filter(
        F.col("year").isin("2000", "2012-2016 ACS")
        & ~F.col("state").isin("ASIA")
        & F.col("metro_name").rlike("[AI]")
        & ~F.col("metro_name").startswith("U")
        & F.col("trt_shr_nhw_pm").isNotNull()
        & (F.col("res_total_est") > 20)
    ).select("unit_id", "year", "state", "metro_name", "res_total_est")


@query(
    "prj_recode_ordered",
    with_ctes(
        "select unit_id, type, year, grp, case grp when 'nhw' then 'NL White' when 'nhb' then 'NL Black' when 'h' then 'Latinx' when 'nha' then 'NL Asian' else 'NL Other' end as race_eth, cast(case when est >= 100 then 3 when est >= 40 then 2 when est >= 10 then 1 else 0 end as bigint) as size_class from f1",
        "f1",
    ),
)
def prj_recode_ordered(spark, sf):
    g, est = F.col("grp"), F.col("est")
    name = F.when(g == "nhw", "NL White").when(g == "nhb", "NL Black").when(g == "h", "Latinx")
    size = F.when(est >= 100, 3).when(est >= 40, 2).when(est >= 10, 1).otherwise(0)
    return fx.unit_counts(spark, sf).select(
        "unit_id",
        "type",
        "year",
        "grp",
        name.when(g == "nha", "NL Asian").otherwise("NL Other").alias("race_eth"),
        size.cast("bigint").alias("size_class"),
    )


# Fixed values: (state, county) pairs of the fixture that get another name.
NAME_REPAIRS = [
    ({"state": "AMERICA", "metro_name": "PERU"}, "Peru"),
    ({"state": "ASIA", "metro_name": "CHINA"}, "La China"),
]


@query(
    "prj_conditional_fix",
    with_ctes(
        "select unit_id, year, state, case when state = 'AMERICA' and metro_name = 'PERU' then 'Peru' when state = 'ASIA' and metro_name = 'CHINA' then 'La China' else metro_name end as metro_name from f2",
        "f2",
    ),
)
def prj_conditional_fix(spark, sf):
    u = fx.units(spark, sf).select("unit_id", "year", "state", "metro_name")
    return reshape.repair(u, "metro_name", NAME_REPAIRS)


@query(
    "prj_indicators",
    with_ctes(
        f"""select unit_id, year, {r6('res_total_est / 1e4')} as tot_10k, {r6('res_nhb_est / nullif(res_total_est, 0)')} as shr_nhb,
 {r6('(res_h_est + res_nha_est) / nullif(res_total_est, 0)')} as shr_h_nha, pow_total_est - 1960 as offset_1960, {r6('ln(nullif(pow_total_est, 0))')} as log_pow,
 {r6('pow_total_est / nullif(res_total_est, 0)')} as jobs_per_worker from f2""",
        "f2",
    ),
)
def prj_indicators(spark, sf):
    c = F.col
    return fx.units(spark, sf).select(
        "unit_id",
        "year",
        rounded(c("res_total_est") / 1e4).alias("tot_10k"),
        rounded(ratio("res_nhb_est", "res_total_est")).alias("shr_nhb"),
        rounded(ratio(c("res_h_est") + c("res_nha_est"), "res_total_est")).alias("shr_h_nha"),
        (c("pow_total_est") - 1960).alias("offset_1960"),
        rounded(F.ln(F.nullif(c("pow_total_est"), F.lit(0.0)))).alias("log_pow"),
        rounded(ratio("pow_total_est", "res_total_est")).alias("jobs_per_worker"),
    )


def _coded(unit: str, i: int) -> str:
    """An invented count for the ``i``-th source column, as SQL."""
    return f"(({unit} * {7 * i + 3}) % 1009) * 1e0"


_SHARE_SQL = ", ".join(f"{r6('(' + ' + '.join(parts) + f') / nullif({whole}, 0)')} as {name}" for name, (parts, whole) in INDICATOR_SHARES.items())
_COUNT_SQL = ", ".join(f"{r6(f'{c} / {unit:g}e0')} as {name}" for name, (c, unit) in INDICATOR_COUNTS.items())


@query(
    "prj_tract_indicators",
    "with coded as (select c_custkey as unit_id, " + ", ".join(f"{_coded('c_custkey', i)} as {c}" for i, c in enumerate(indicator_codes()))
    + f" from customer) select unit_id, {_COUNT_SQL}, {_SHARE_SQL}, " + ", ".join(f"{c} - {year} as {name}" for name, (c, year) in INDICATOR_YEARS.items()) + " from coded",
)
def prj_tract_indicators(spark, sf):
    """The twelve tract indicators from coded columns."""
    codes = [F.expr(_coded("c_custkey", i)).alias(c) for i, c in enumerate(indicator_codes())]
    coded = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("unit_id"), *codes)
    t = tract_indicators(coded, ["unit_id"])
    return reshape.across(t, [*INDICATOR_COUNTS, *INDICATOR_SHARES], rounded)


# Which source columns make up each tract total, per period.
TOTAL_CODES = {
    period: {
        "trt_tot_pop": ["res_total_est", "pow_total_est"],
        "trt_tot_nhw": ["res_nhw_est", "pow_nhw_est"],
        "trt_tot_h_nha": ["res_h_est", "res_nha_est", "pow_h_est", "pow_nha_est"],
    }
    for period in PERIODS
}


@query(
    "prj_code_totals",
    with_ctes(
        "select unit_id, year, res_total_est + pow_total_est as trt_tot_pop, res_nhw_est + pow_nhw_est as trt_tot_nhw, res_h_est + res_nha_est + pow_h_est + pow_nha_est as trt_tot_h_nha from f2",
        "f2",
    ),
)
def prj_code_totals(spark, sf):
    u = settle(fx.units(spark, sf))
    parts = [
        u.filter(F.col("year") == period).select("unit_id", *reshape.code_totals(codes, period))
        for period, codes in TOTAL_CODES.items()
    ]
    return reshape.stack(*parts)


@query(
    "prj_flag_nullsafe",
    "select o_orderkey, (o_custkey % 7 <> 0 and o_orderstatus <> 'F') as flag from orders",
)
def prj_flag_nullsafe(spark, sf):
    o = fx.table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "N").otherwise("Y")
    known = o.withColumn("status", F.when(F.col("o_custkey") % 7 != 0, status))
    return known.select("o_orderkey", F.coalesce(F.col("status") != "N", F.lit(False)).alias("flag"))


@query(
    "prj_percent_label",
    with_ctes(
        "select unit_id, year, concat(cast(cast(round(trt_shr_nhw_pm * 100) as bigint) as varchar), '%') as label from sh where trt_shr_nhw_pm is not null",
        "sh",
    ),
)
def prj_percent_label(spark, sf):
    u = fx.composed(spark, sf).filter(F.col("trt_shr_nhw_pm").isNotNull())
    return u.select("unit_id", "year", percent_label("trt_shr_nhw_pm").alias("label"))


@query(
    "prj_clamp",
    with_ctes(
        f"select unit_id, year, {r6('case when chg_nho < 0 then 0e0 else chg_nho end')} as chg_nho, {r6('case when trt_shr_nho_pm < 0 then 0e0 else trt_shr_nho_pm end')} as trt_shr_nho_pm from sh",
        "sh",
    ),
)
def prj_clamp(spark, sf):
    u = reshape.across(fx.composed(spark, sf), ["chg_nho", "trt_shr_nho_pm"], at_least_zero)
    return u.select("unit_id", "year", rounded("chg_nho").alias("chg_nho"), rounded("trt_shr_nho_pm").alias("trt_shr_nho_pm"))


@query("prj_distinct", with_ctes("select distinct metro_id, metro_name, year, prin_city from f2", "f2"))
def prj_distinct(spark, sf):
    return fx.units(spark, sf).select("metro_id", "metro_name", "year", "prin_city").distinct()


@query(
    "srt_order",
    with_ctes(
        "select metro_id, year, sum(res_total_est) as workers from f2 group by 1, 2 order by workers desc, metro_id, year",
        "f2",
    ),
)
def srt_order(spark, sf):
    by_metro = fx.units(spark, sf).groupBy("metro_id", "year").agg(F.sum("res_total_est").alias("workers"))
    return by_metro.orderBy(F.desc("workers"), "metro_id", "year")


@query(
    "shp_pivot_multi",
    with_ctes(
        """select unit_id, year, grp, max(case when type='res' then est end) as res_est, max(case when type='pow' then est end) as pow_est,
 max(case when type='res' then n end) as res_n, max(case when type='pow' then n end) as pow_n from f1 group by 1, 2, 3""",
        "f1",
    ),
)
def shp_pivot_multi(spark, sf):
    return reshape.widen(
        fx.unit_counts(spark, sf), ["unit_id", "year", "grp"], "type", ["res", "pow"], ["est", "n"]
    )


@query(
    "shp_pivot_single",
    with_ctes(
        "select unit_id, year, type, "
        + ", ".join(f"sum(case when grp='{g}' then est end) as tot_{g}" for g in GROUPS)
        + " from f1 group by 1, 2, 3",
        "f1",
    ),
)
def shp_pivot_single(spark, sf):
    return reshape.widen_sum(
        fx.unit_counts(spark, sf), ["unit_id", "year", "type"], "grp", GROUPS, "est", "tot_"
    )


@query(
    "shp_unpivot",
    with_ctes(
        " union all ".join(
            f"select unit_id, year, '{c}' as name, {c} as value from f2"
            for c in ("res_nhw_est", "res_nhb_est", "pow_nhw_est")
        ),
        "f2",
    ),
)
def shp_unpivot(spark, sf):
    u = fx.units(spark, sf)
    return u.unpivot(["unit_id", "year"], ["res_nhw_est", "res_nhb_est", "pow_nhw_est"], "name", "value")


@query(
    "shp_unnest",
    with_ctes(
        "select unit_id, year, 'night' as time, res_total_est as workers, res_nhw_est as white from f2 union all select unit_id, year, 'day', pow_total_est, pow_nhw_est from f2",
        "f2",
    ),
)
def shp_unnest(spark, sf):
    part = lambda time, p: F.struct(
        F.lit(time).alias("time"),
        F.col(f"{p}_total_est").alias("workers"),
        F.col(f"{p}_nhw_est").alias("white"),
    )
    nested = fx.units(spark, sf).select(
        "unit_id", "year", F.array(part("night", "res"), part("day", "pow")).alias("by_time")
    )
    return reshape.expand_nested(nested, ["unit_id", "year"], "by_time")


@query(
    "shp_level_order",
    with_ctes(
        """select pm_cat, ordinal, n from (select pm_cat, cast(row_number() over (order by med, pm_cat) as bigint) as ordinal from (select pm_cat, median(chg_nhw) as med from ty group by 1)) o
 join (select pm_cat, cast(count(*) as bigint) as n from ty group by 1) c using (pm_cat)""",
        "ty",
    ),
)
def shp_level_order(spark, sf):
    t = fx.typed(spark, sf)
    levels = ordered_levels(t, "pm_cat", "chg_nhw")
    counts = t.groupBy("pm_cat").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(levels, "pm_cat").select("pm_cat", F.col("ordinal").cast("bigint").alias("ordinal"), "n")


@query(
    "shp_cross_label",
    with_ctes(
        "select pm_am, split_part(pm_am, ':', 1) as pm_cat, split_part(pm_am, ':', 2) as am_cat, cast(count(*) as bigint) as n from (select concat(pm_cat, ':', am_cat) as pm_am from ty) group by 1, 2, 3",
        "ty",
    ),
)
def shp_cross_label(spark, sf):
    crossed = fx.typed(spark, sf).select(cross_label("pm_cat", "am_cat").alias("pm_am"))
    return (
        crossed.groupBy("pm_am")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "pm_am",
            split_piece("pm_am", ":", 2, 1).alias("pm_cat"),
            split_piece("pm_am", ":", 2, 2).alias("am_cat"),
            "n",
        )
    )


@query(
    "shp_collapse_label",
    with_ctes(
        """select case when contains(pm_am, 'Predominantly Black') then pm_am else 'Other' end as res_blk, case when contains(pm_am, 'Predominantly Latinx') then pm_am else 'Other' end as res_lat,
 case when contains(pm_am, 'Multiethnic') then pm_am else 'Other' end as res_mult, cast(count(*) as bigint) as n from (select concat(pm_cat, ', ', am_cat) as pm_am from ty) group by 1, 2, 3""",
        "ty",
    ),
)
def shp_collapse_label(spark, sf):
    crossed = fx.typed(spark, sf).select(cross_label("pm_cat", "am_cat", ", ").alias("pm_am"))
    return crossed.groupBy(
        keep_label("pm_am", TYPES_7[1]).alias("res_blk"),
        keep_label("pm_am", TYPES_7[3]).alias("res_lat"),
        keep_label("pm_am", TYPES_7[6]).alias("res_mult"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "set_union_by_name",
    with_ctes(
        "select unit_id, year, res_total_est as workers, cast(null as boolean) as prin_city, 'night' as time from f2 union all select unit_id, year, pow_total_est, prin_city, 'day' from f2",
        "f2",
    ),
)
def set_union_by_name(spark, sf):
    u = fx.units(spark, sf)
    night = u.select("unit_id", "year", F.col("res_total_est").alias("workers"), F.lit("night").alias("time"))
    day = u.select(
        "unit_id", "year", F.col("pow_total_est").alias("workers"), "prin_city", F.lit("day").alias("time")
    )
    return reshape.stack(night, day)


@query(
    "set_replace_period",
    with_ctes(
        f"""select unit_id, year, res_total_est, pow_total_est from f2 where year <> '2000' union all
 select to_id, year, sum(res_total_est * weight), sum(pow_total_est * weight) from f2 join f4 on unit_id = from_id where year = '2000' and to_id is not null group by 1, 2""",
        "f2",
        "f4",
    ),
)
def set_replace_period(spark, sf):
    u = fx.units(spark, sf).select("unit_id", "year", "res_total_est", "pow_total_est")
    moved = reallocate(
        u.filter(F.col("year") == "2000"),
        fx.crosswalk(spark, sf),
        "unit_id",
        "from_id",
        "to_id",
        "weight",
        ["res_total_est", "pow_total_est"],
    )
    return reshape.replace_period(u, "2000", moved)
