"""Queries: aggregations, windows, ranks, top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nulls
from ..functions.composition import PERIODS
from ..functions.nulls import rounded
from ..operators import order, reshape
from ..operators.segregation import qualifying_groups
from ..operators.spatial import density_profile
from ..plans.analyses import race_eth
from ..session import settle
from . import fixtures as fx
from .fixtures import r6, with_ctes
from .registry import query

@query(
    "agg_sum_skip",
    with_ctes(
        f"select metro_id, year, {r6('coalesce(sum(trt_shr_nhw_pm), 0)')} as shr_sum, coalesce(sum(case when res_total_est > 200 then res_total_est end), 0) as big_total from sh group by 1, 2",
        "sh",
    ),
)


def agg_sum_skip(spark, sf):
    big = F.when(F.col("res_total_est") > 200, F.col("res_total_est"))
    return (
        fx.composed(spark, sf)
        .groupBy("metro_id", "year")
        .agg(
            rounded(nulls.sum_or_zero("trt_shr_nhw_pm")).alias("shr_sum"),
            nulls.sum_or_zero(big).alias("big_total"),
        )
    )


@query(
    "agg_sum_strict",
    with_ctes(
        f"select metro_id, year, {r6('case when count(trt_shr_nhw_pm) = count(*) then sum(trt_shr_nhw_pm) end')} as night, {r6('case when count(trt_shr_nhw_am) = count(*) then sum(trt_shr_nhw_am) end')} as day, sum(res_total_est) as total from sh group by 1, 2",
        "sh",
    ),
)


def agg_sum_strict(spark, sf):
    return (
        fx.composed(spark, sf)
        .groupBy("metro_id", "year")
        .agg(
            rounded(nulls.strict_sum("trt_shr_nhw_pm")).alias("night"),
            rounded(nulls.strict_sum("trt_shr_nhw_am")).alias("day"),
            nulls.strict_sum("res_total_est").alias("total"),
        )
    )


@query("agg_tally", with_ctes("select year, pm_cat, am_cat, cast(count(*) as bigint) as n from ty group by 1, 2, 3", "ty"))
def agg_tally(spark, sf):
    return fx.typed(spark, sf).groupBy("year", "pm_cat", "am_cat").count().withColumnRenamed("count", "n")


@query(
    "agg_count_distinct",
    with_ctes(
        "select metro_id, cast(count(distinct unit_id) as bigint) as n_units, cast(count(distinct flag) + max(case when flag is null then 1 else 0 end) as bigint) as n_flags from (select *, case when res_total_est > 0 then prin_city end as flag from f2) group by 1",
        "f2",
    ),
)


def agg_count_distinct(spark, sf):
    flag = F.when(F.col("res_total_est") > 0, F.col("prin_city"))
    return (
        fx.units(spark, sf)
        .withColumn("flag", flag)
        .groupBy("metro_id")
        .agg(
            nulls.count_distinct_with_null("unit_id").cast("bigint").alias("n_units"),
            nulls.count_distinct_with_null("flag").cast("bigint").alias("n_flags"),
        )
    )


@query(
    "agg_mean_median",
    with_ctes(
        f"""select metro_id, year, {r6('avg(trt_shr_nhw_pm)')} as mean_skip, {r6('case when count(trt_shr_nhw_pm) = count(*) then avg(trt_shr_nhw_pm) end')} as mean_strict,
 {r6('case when count(trt_shr_nhw_pm) = count(*) then median(trt_shr_nhw_pm) end')} as med_trt_shr_nhw_pm, {r6('median(res_total_est)')} as med_res_total_est from sh group by 1, 2""",
        "sh",
    ),
)


def agg_mean_median(spark, sf):
    u, keys = settle(fx.composed(spark, sf)), ["metro_id", "year"]
    means = u.groupBy(*keys).agg(
        rounded(F.avg("trt_shr_nhw_pm")).alias("mean_skip"),
        rounded(nulls.strict_avg("trt_shr_nhw_pm")).alias("mean_strict"),
    )
    med = order.medians(u, keys, ["trt_shr_nhw_pm", "res_total_est"], "med_")
    med = reshape.across(med, reshape.starting_with(med, "med_"), rounded)
    return means.join(med, keys)


@query(
    "agg_conditional",
    with_ctes(
        f"""select metro_id, year, {r6('avg(case when prin_city then res_total_est end)')} as city_mean, {r6('avg(case when not prin_city then res_total_est end)')} as suburb_mean,
 coalesce(sum(case when not prin_city then res_total_est end), 0) as suburb_total, cast(count(case when pm_cat = 'Multiethnic' then 1 end) as bigint) as n_multi from ty group by 1, 2""",
        "ty",
    ),
)


def agg_conditional(spark, sf):
    city = F.col("prin_city")
    return (
        fx.typed(spark, sf)
        .groupBy("metro_id", "year")
        .agg(
            rounded(nulls.subset_avg("res_total_est", city)).alias("city_mean"),
            rounded(nulls.subset_avg("res_total_est", ~city)).alias("suburb_mean"),
            nulls.sum_or_zero(F.when(~city, F.col("res_total_est"))).alias("suburb_total"),
            F.count_if(F.col("pm_cat") == "Multiethnic").alias("n_multi"),
        )
    )


@query(
    "agg_threshold_flag",
    with_ctes(
        "select metro_id, "
        + ", ".join(f"case when coalesce(sum({c}), 0) >= {v:g} then metro_id end as ok_{c}" for c, v in fx.ELIGIBILITY.items())
        + " from f2 where year = '2000' group by 1",
        "f2",
    ),
)


def agg_threshold_flag(spark, sf):
    base = fx.units(spark, sf).filter(F.col("year") == "2000")
    return qualifying_groups(base, "metro_id", fx.ELIGIBILITY)


@query(
    "agg_pick_by_kind",
    with_ctes(
        f"""select unit_id, year, {r6("max(case when type = 'res' then t end) / ln(4e0) * 100")} as res_scaled, {r6("max(case when type = 'pow' then t end) / ln(4e0) * 100")} as pow_scaled
 from (select unit_id, year, type, sum(est) as t from f1 group by 1, 2, 3) group by 1, 2 having count(case when type = 'res' then 1 end) > 0 and count(case when type = 'pow' then 1 end) > 0""",
        "f1",
    ),
)


def agg_pick_by_kind(spark, sf):
    totals = fx.unit_counts(spark, sf).groupBy("unit_id", "year", "type").agg(F.sum("est").alias("t"))
    pick = lambda kind: F.max(F.when(F.col("type") == kind, F.col("t")))
    scaled = lambda c: rounded(F.col(c) / F.ln(F.lit(4.0)) * 100)
    both = totals.groupBy("unit_id", "year").agg(pick("res").alias("r"), pick("pow").alias("p")).dropna()
    return both.select("unit_id", "year", scaled("r").alias("res_scaled"), scaled("p").alias("pow_scaled"))


@query(
    "agg_scalar_unique",
    with_ctes(
        f"select metro_id, year, max(metro_name) as metro_name, max(state) as state, {r6('log10(nullif(sum(res_total_est), 0))')} as log_pop from f2 group by 1, 2",
        "f2",
    ),
)


def agg_scalar_unique(spark, sf):
    return (
        fx.units(spark, sf)
        .groupBy("metro_id", "year")
        .agg(
            nulls.group_constant("metro_name").alias("metro_name"),
            F.max("state").alias("state"),
            rounded(F.log10(F.nullif(F.sum("res_total_est"), F.lit(0.0)))).alias("log_pop"),
        )
    )


@query(
    "agg_weighted_mean",
    with_ctes(
        f"select met_id, yr, {r6('cast(sum(occscore * perwt) as double) / sum(perwt)')} as mean_occ, {r6('cast(sum(sei * perwt) as double) / sum(perwt)')} as mean_sei from f7 group by 1, 2",
        "f7",
    ),
)


def agg_weighted_mean(spark, sf):
    return (
        fx.persons(spark, sf)
        .groupBy("met_id", "yr")
        .agg(
            rounded(nulls.weighted_avg("occscore", "perwt")).alias("mean_occ"),
            rounded(nulls.weighted_avg("sei", "perwt")).alias("mean_sei"),
        )
    )


def weighted_median_sql(source: str, keys: str, x: str, w: str) -> str:
    """Interpolated weighted median with midpoints, as a derived table (keys, wmed)."""
    return f"""(select {keys}, case when max(c) filter (c <= half) is null then arg_min(x, c) filter (c > half)
   when min(c) filter (c > half) is null then arg_max(x, c) filter (c <= half)
   else arg_max(x, c) filter (c <= half) + (arg_min(x, c) filter (c > half) - arg_max(x, c) filter (c <= half))
     * ((max(half) - max(c) filter (c <= half)) / (min(c) filter (c > half) - max(c) filter (c <= half))) end as wmed
  from (select {keys}, cast({x} as double) as x,
      sum({w}) over (partition by {keys} order by {x}, {w} rows unbounded preceding) - {w} / 2e0 as c,
      sum({w}) over (partition by {keys}) / 2e0 as half from {source} where {w} > 0)
  group by {keys})"""


@query(
    "agg_weighted_median",
    with_ctes(f"select met_id, yr, {r6('wmed')} as med_hh_inc from {weighted_median_sql('f7', 'met_id, yr', 'hhincome', 'hhwt')}", "f7"),
)


def agg_weighted_median(spark, sf):
    med = order.weighted_medians(fx.persons(spark, sf), ["met_id", "yr"], "hhincome", "hhwt", "med_hh_inc")
    return med.withColumn("med_hh_inc", rounded("med_hh_inc"))


@query(
    "agg_weighted_indicator",
    with_ctes(
        "select met_id, yr, cast(sum(case when bpl between 1 and 99 then 0 else perwt end) as bigint) as tot_for_born from (select * replace (nullif(bpl, 5) as bpl) from f7) group by 1, 2",
        "f7",
    ),
)


def agg_weighted_indicator(spark, sf):
    p = fx.persons(spark, sf).withColumn("bpl", F.nullif("bpl", F.lit(5)))
    abroad = ~F.coalesce(F.col("bpl").between(1, 99), F.lit(False))
    return p.groupBy("met_id", "yr").agg(nulls.weight_where(abroad, "perwt").cast("bigint").alias("tot_for_born"))


_EARN = """dat as (select type, o as v from (select type, cast(o_totalprice as double) as o from (select case o_orderstatus when 'O' then 'pow' else 'res' end as type, o_totalprice from orders)))"""


@query(
    "agg_density_profile",
    f"""with {_EARN},
st as (select type, count(*) as n_all, stddev_samp(v) as sd, min(v) as low, max(v) as high, quantile_cont(v, 0.25e0) as q1, quantile_cont(v, 0.75e0) as q3 from dat group by 1),
bw as (select *, 0.9e0 * least(sd, (q3 - q1) / 1.34e0) * pow(n_all, -0.2e0) as bw from st),
grid as (select bw.*, i, low - 3 * bw + i * (high - low + 6 * bw) / 63 as gx from bw, range(64) t(i))
select grid.type, cast(i as bigint) as i, round(max(gx), 2) as grid_x, {r6("1e5 * sum(exp(-0.5e0 * pow((gx - v) / bw, 2))) / (max(n_all) * max(bw) * sqrt(2 * pi()))")} as density_100k
from grid join dat on grid.type = dat.type group by 1, 2""",
)


def agg_density_profile(spark, sf):
    o = fx.table(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") == "O", "pow").otherwise("res").alias("type"), "o_totalprice"
    )
    return density_profile(o, ["type"], "o_totalprice").select(
        "type",
        F.col("i").cast("bigint").alias("i"),
        F.round("grid_x", 2).alias("grid_x"),
        rounded(F.col("density") * 1e5).alias("density_100k"),
    )


@query(
    "win_share_of_total",
    with_ctes(
        f"select year, pm_cat, am_cat, n, cast(sum(n) over (partition by year, pm_cat) as bigint) as total, {r6('cast(n as double) / sum(n) over (partition by year, pm_cat)')} as shr from (select year, pm_cat, am_cat, cast(count(*) as bigint) as n from ty group by 1, 2, 3)",
        "ty",
    ),
)


def win_share_of_total(spark, sf):
    counts = fx.typed(spark, sf).groupBy("year", "pm_cat", "am_cat").agg(F.count(F.lit(1)).alias("n"))
    out = reshape.shares_of_total(counts, ["year", "pm_cat"], "n", spread=["am_cat"])
    return out.withColumn("shr", rounded("shr"))


_RACE = "case when race = 1 and hispan = 0 then 'NL White' when race = 2 and hispan = 0 then 'NL Black' when race between 4 and 6 and hispan = 0 then 'NL Asian/PI' when hispan between 1 and 4 then 'Latino' else 'NL Other' end"


@query(
    "win_ratio_to_reference",
    with_ctes(
        f"""select met_id, yr, race_eth, {r6('m')} as mean_sei, {r6("m / nullif(max(case when race_eth = 'NL White' then m end) over (partition by met_id, yr), 0)")} as sei_ratio
 from (select met_id, yr, {_RACE} as race_eth, cast(sum(sei * perwt) as double) / sum(perwt) as m from f7 group by 1, 2, 3)""",
        "f7",
    ),
)


def win_ratio_to_reference(spark, sf):
    means = (
        fx.persons(spark, sf)
        .groupBy("met_id", "yr", race_eth().alias("race_eth"))
        .agg(nulls.weighted_avg("sei", "perwt").alias("mean_sei"))
    )
    out = reshape.ratio_to_reference(means, ["met_id", "yr"], "race_eth", "NL White", {"sei_ratio": "mean_sei"})
    return reshape.across(out, ["mean_sei", "sei_ratio"], rounded)


@query(
    "win_rank_avg_ties",
    with_ctes(
        """select unit_id, year, res_total_est, r1 + (c1 - 1) / 2e0 as up, r2 + (c2 - 1) / 2e0 as down from (select unit_id, year, res_total_est,
 rank() over (partition by year order by res_total_est) as r1, count(*) over (partition by year, res_total_est) as c1,
 rank() over (partition by year order by pow_total_est desc) as r2, count(*) over (partition by year, pow_total_est) as c2 from f2)""",
        "f2",
    ),
)


def win_rank_avg_ties(spark, sf):
    u = settle(fx.units(spark, sf).select("unit_id", "year", "res_total_est", "pow_total_est"))
    u = order.add_rank(u, ["year"], "res_total_est", "up")
    u = order.add_rank(u, ["year"], "pow_total_est", "down", descending=True)
    return u.drop("pow_total_est")


@query(
    "win_rank_extremes",
    with_ctes(
        f"""select metro_id, unit_id, year, {r6('chg_nhw')} as chg_nhw, rank from (select metro_id, unit_id, year, chg_nhw,
 rank() over (partition by metro_id order by chg_nhw desc) + (count(*) over (partition by metro_id, chg_nhw) - 1) / 2e0 as rank from ty) where rank between 1 and 10 and rank = floor(rank)""",
        "ty",
    ),
)


def win_rank_extremes(spark, sf):
    t = settle(fx.typed(spark, sf).select("metro_id", "unit_id", "year", "chg_nhw"))
    ranked = order.add_rank(t, ["metro_id"], "chg_nhw", "rank", descending=True)
    top = ranked.filter(F.col("rank").between(1, 10) & (F.col("rank") == F.floor("rank")))
    return top.withColumn("chg_nhw", rounded("chg_nhw"))


@query(
    "win_top_n_ties",
    with_ctes(
        """select 'all' as scope, metro_id, unit_id, year, res_total_est from (select *, rank() over (order by res_total_est desc) as r from f2) where r <= 50
 union all select 'metro', metro_id, unit_id, year, res_total_est from (select *, rank() over (partition by metro_id order by res_total_est desc) as r from f2) where r <= 3""",
        "f2",
    ),
)


def win_top_n_ties(spark, sf):
    u = settle(fx.units(spark, sf).select("metro_id", "unit_id", "year", "res_total_est"))
    overall = order.top_with_ties(u, 50, "res_total_est")
    by_metro = order.top_with_ties(u, 3, "res_total_est", ["metro_id"], ["unit_id"])
    return reshape.stack(
        overall.withColumn("scope", F.lit("all")), by_metro.withColumn("scope", F.lit("metro"))
    )


@query(
    "win_fill_down",
    with_ctes(
        """select unit_id, year, last_value(known ignore nulls) over (partition by unit_id order by case year when '2006-2010 ACS' then 1 when '2012-2016 ACS' then 2 else 3 end rows unbounded preceding) as known
 from (select unit_id, year, case when year = '2006-2010 ACS' or unit_id % 4 = 0 then metro_name || year end as known from f2)""",
        "f2",
    ),
)


def win_fill_down(spark, sf):
    known = F.when(
        (F.col("year") == "2006-2010 ACS") | (F.col("unit_id") % 4 == 0), F.concat("metro_name", "year")
    )
    u = settle(fx.units(spark, sf).select("unit_id", "year", known.alias("known")))
    place = F.array_position(F.lit([*PERIODS[1:], PERIODS[0]]), F.col("year"))
    return order.fill_down(u, ["unit_id"], [place], ["known"])


@query(
    "win_zscore",
    with_ctes(
        f"select unit_id, year, {r6('(chg_nhw - avg(chg_nhw) over ()) / stddev_samp(chg_nhw) over ()')} as chg_nhw, {r6('(res_total_est - avg(res_total_est) over ()) / stddev_samp(res_total_est) over ()')} as res_total_est from ty",
        "ty",
    ),
)


def win_zscore(spark, sf):
    t = settle(fx.typed(spark, sf).select("unit_id", "year", "chg_nhw", "res_total_est"))
    return reshape.across(reshape.zscores(t, ["chg_nhw", "res_total_est"]), ["chg_nhw", "res_total_est"], rounded)
