"""Queries: composition, diversity, segregation, flows, panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nulls
from ..functions.composition import GROUPS, TYPES_7, segregation_level, type9
from ..functions.nulls import rounded
from ..functions.text import parse_tract_label
from ..operators import joins, order, reshape, segregation
from ..operators.spatial import area_indices, spatial_indices
from ..plans.analyses import (
    DIVERSITY,
    EARN_BANDS,
    EARN_SHARES,
    add_day_night_flags,
    earnings_profile,
    metro_layers,
    multidim_diversity,
    od_flows,
    person_panel,
    with_entropy,
)
from ..plans.builds import flow_build
from ..session import settle
from ..sources import extracts
from . import fixtures as fx
from .files import write_flow_files
from .fixtures import entropy_sql, r6, with_ctes
from .grouping import _RACE, weighted_median_sql
from .joining import DIMENSION_SQL, all_dimensions
from .registry import query
from .strings import BRACKET_SQL

METRO = ["metro_id", "metro_name", "year"]
PAIRS = {f"dis_{g}_nhw": (f"trt_tot_{g}", "trt_tot_nhw") for g in ("nhb", "h", "nha")}
SIDES = {"Residence": "res", "Workplace": "pow"}
MINORITIES = {"Black-White": "nhb", "Latinx-White": "h", "Asian-White": "nha"}
# Raster settings for the fixture plane: cell side, kernel radius and decay.
CELL, RADIUS, BETA = 0.25, 1.0, 4.0


def _rounded_all(df, columns):
    return reshape.across(df, columns, rounded)


def with_totals(spark, sf):
    """f3: f2 with night and day counts added up."""
    u = settle(fx.units(spark, sf))
    names = ["total", *GROUPS]
    return u.withColumns({f"trt_tot_{g}": F.col(f"res_{g}_est") + F.col(f"pow_{g}_est") for g in names})


_F3 = "f3 as (select *, " + ", ".join(f"res_{g}_est + pow_{g}_est as trt_tot_{g}" for g in ("total", *GROUPS)) + " from f2)"


def dissimilarity_sql(source: str, keys: str, a: str, b: str) -> str:
    """D per group as a derived table (keys, d)."""
    return f"""(select {keys}, case when count(gap) = count(*) then 0.5e0 * sum(gap) end as d from
 (select {keys}, abs({a} / nullif(sum({a}) over (partition by {keys}), 0) - {b} / nullif(sum({b}) over (partition by {keys}), 0)) as gap from {source}) group by {keys})"""


_SHARES = [f"trt_shr_{g}_{s}" for s in ("pm", "am") for g in GROUPS]


@query(
    "msr_shares",
    with_ctes("select unit_id, year, " + ", ".join(f"{r6(c)} as {c}" for c in _SHARES) + " from sh", "sh"),
)


def msr_shares(spark, sf):
    return _rounded_all(fx.composed(spark, sf).select("unit_id", "year", *_SHARES), _SHARES)


_CHANGES = [f"chg_{g}" for g in GROUPS]


@query(
    "msr_intraday_change",
    with_ctes("select unit_id, year, " + ", ".join(f"{r6(c)} as {c}" for c in _CHANGES) + " from sh", "sh"),
)


def msr_intraday_change(spark, sf):
    return _rounded_all(fx.composed(spark, sf).select("unit_id", "year", *_CHANGES), _CHANGES)


@query("msr_typology7", with_ctes("select unit_id, year, pm_cat, am_cat from ty", "ty"))
def msr_typology7(spark, sf):
    return fx.typed(spark, sf).select("unit_id", "year", "pm_cat", "am_cat")


def _type9_sql(side: str) -> str:
    s = lambda g: f"trt_shr_{g}_{side}"
    mixed = " ".join(
        f"when {s(g)} < 0.75e0 and {s(g)} >= 0.5e0 then '{name}-Mixed'"
        for g, name in [("nhb", "Black"), ("h", "Latinx"), ("nha", "Asian")]
    )
    return f"case when {side}_cat = 'Non-White-Mixed' then case {mixed} end else {side}_cat end"


_TY9 = f"ty9 as (select * replace ({_type9_sql('pm')} as pm_cat, {_type9_sql('am')} as am_cat) from ty)"


def typed9(spark, sf):
    return fx.typed(spark, sf).withColumns({"pm_cat": type9("pm"), "am_cat": type9("am")})


@query("msr_typology9", with_ctes(f"with {_TY9} select unit_id, year, pm_cat, am_cat from ty9", "ty"))
def msr_typology9(spark, sf):
    return typed9(spark, sf).select("unit_id", "year", "pm_cat", "am_cat")


def _flag_sql(side: str, time: str, part: str, word: str) -> str:
    return f"case when contains({side}_cat, '{part}') then '{word} {time}' else 'Not {word} {time}' end"


_PREDOM_SQL = f"{_flag_sql('pm', 'Nighttime', 'Predominantly', 'Segregated')} || ', ' || {_flag_sql('am', 'Daytime', 'Predominantly', 'Segregated')}"
_MULT_SQL = f"{_flag_sql('pm', 'Nighttime', 'Multiethnic', 'Multiethnic')} || ', ' || {_flag_sql('am', 'Daytime', 'Multiethnic', 'Multiethnic')}"


@query(
    "msr_day_night_crosses",
    with_ctes(f"with {_TY9} select unit_id, year, {_PREDOM_SQL} as predom_pm_am, {_MULT_SQL} as mult_pm_am from ty9", "ty"),
)


def msr_day_night_crosses(spark, sf):
    return add_day_night_flags(typed9(spark, sf)).select("unit_id", "year", "predom_pm_am", "mult_pm_am")


def _matrix_sql(keys: list[str]) -> str:
    k = ", ".join(keys)
    grids = ", ".join(f"(select distinct {c} from ty)" for c in [*keys, "pm_cat", "am_cat"])
    return f"""select {k}, pm_cat, am_cat, n, {r6('shr')} as shr, cast(sum(n) over (partition by {k}, pm_cat) as bigint) as total from
 (select {k}, pm_cat, am_cat, coalesce(n, 0) as n, coalesce(shr, 0) as shr from (select * from {grids}) g left join
 (select *, cast(n as double) / sum(n) over (partition by {k}, pm_cat) as shr from (select {k}, pm_cat, am_cat, cast(count(*) as bigint) as n from ty group by all)) c using ({k}, pm_cat, am_cat))"""


@query("msr_transition_matrix", with_ctes(_matrix_sql(["year"]), "ty"))
def msr_transition_matrix(spark, sf):
    m = segregation.transition_matrix(fx.typed(spark, sf), ["year"], "pm_cat", "am_cat")
    return m.withColumn("shr", rounded("shr"))


@query("msr_transition_matrix_split", with_ctes(_matrix_sql(["prin_city", "year"]), "ty"))
def msr_transition_matrix_split(spark, sf):
    m = segregation.transition_matrix(fx.typed(spark, sf), ["prin_city", "year"], "pm_cat", "am_cat")
    return m.withColumn("shr", rounded("shr"))


def _snake(label: str) -> str:
    return label.lower().replace(" ", "_").replace("-", "_")


@query(
    "msr_change_wide",
    with_ctes(
        "select year, pm_cat, total, "
        + ", ".join(f"{r6(f'max(case when am_cat = {t!r} then cast(n as double) / total end)')} as shr_{_snake(t)}" for t in TYPES_7)
        + " from (select *, cast(sum(n) over (partition by year, pm_cat) as bigint) as total from (select year, pm_cat, am_cat, count(*) as n from ty group by 1, 2, 3)) group by 1, 2, 3",
        "ty",
    ),
)


def msr_change_wide(spark, sf):
    counts = fx.typed(spark, sf).groupBy("year", "pm_cat", "am_cat").agg(F.count(F.lit(1)).alias("n"))
    shares = reshape.shares_of_total(counts, ["year", "pm_cat"], "n", spread=["am_cat"])
    wide = reshape.widen(shares, ["year", "pm_cat", "total"], "am_cat", TYPES_7, ["shr"])
    names = {f"{t}_shr": f"shr_{_snake(t)}" for t in TYPES_7}
    return _rounded_all(wide.withColumnsRenamed(names), list(names.values()))


_LEVEL = "case when d >= 0.8e0 then 'Extreme Segregation' when d >= 0.6e0 then 'High Segregation' when d >= 0.4e0 then 'Moderate Segregation' when d < 0.4e0 then 'Low Segregation' end"


@query(
    "msr_change_by_seg_level",
    with_ctes(
        f"""with {_F3}, dd as {dissimilarity_sql('f3', 'metro_id, year', 'trt_tot_nhb', 'trt_tot_nhw')},
 c as (select year, seg_cat, pm_cat, am_cat, cast(count(*) as bigint) as n from (select ty.*, {_LEVEL} as seg_cat from ty join dd on ty.metro_id = dd.metro_id and ty.year = dd.year) group by 1, 2, 3, 4)
 select *, cast(sum(n) over (partition by year, seg_cat, pm_cat) as bigint) as total, {r6('cast(n as double) / sum(n) over (partition by year, seg_cat, pm_cat)')} as shr from c""",
        "ty",
    ),
)


def msr_change_by_seg_level(spark, sf):
    keys = ["metro_id", "year"]
    pair = {"dis_nhb_nhw": PAIRS["dis_nhb_nhw"]}
    d = segregation.dissimilarity(with_totals(spark, sf), keys, pair, ["unit_id"])
    t = joins.attach(fx.typed(spark, sf), d, keys, ["unit_id"], "inner")
    level = segregation_level("dis_nhb_nhw").alias("seg_cat")
    counts = t.groupBy("year", level, "pm_cat", "am_cat").agg(F.count(F.lit(1)).alias("n"))
    out = reshape.shares_of_total(counts, ["year", "seg_cat", "pm_cat"], "n", spread=["am_cat"])
    return out.withColumn("shr", rounded("shr"))


@query(
    "msr_mean_composition",
    with_ctes("select year, am_cat, " + ", ".join(f"{r6(f'avg(trt_shr_{g}_am)')} as {g}" for g in GROUPS) + " from ty group by 1, 2", "ty"),
)


def msr_mean_composition(spark, sf):
    means = [rounded(F.avg(f"trt_shr_{g}_am")).alias(g) for g in GROUPS]
    return fx.typed(spark, sf).groupBy("year", "am_cat").agg(*means)


def _entropy_cols(source: str) -> str:
    clamp = ", ".join(f"greatest(trt_shr_nho_{s}, 0e0) as trt_shr_nho_{s}" for s in ("am", "pm"))
    cols = ", ".join(f"{entropy_sql([f'trt_shr_{g}_{s}' for g in GROUPS])} as race_eth_div_{s}" for s in ("am", "pm"))
    return f"(select *, {cols} from (select * replace ({clamp}) from {source} where res_total_est > 0 and pow_total_est > 0))"


@query(
    "msr_entropy",
    with_ctes(f"select unit_id, year, {r6('race_eth_div_pm')} as race_eth_div_pm, {r6('race_eth_div_am')} as race_eth_div_am from {_entropy_cols('ty')}", "ty"),
)


def msr_entropy(spark, sf):
    cols = ["race_eth_div_pm", "race_eth_div_am"]
    return _rounded_all(with_entropy(fx.typed(spark, sf)).select("unit_id", "year", *cols), cols)


def multidim(spark, sf):
    return multidim_diversity(all_dimensions(spark, sf))


def _multidim_sql() -> str:
    share = lambda c: f"(\"{c}\" / nullif(tot_sex_male + tot_sex_female, 0))"
    divs = ", ".join(
        f"({entropy_sql([share(c) for c in parts])}) / ln({len(parts)}e0) * 100 as {n}_div" for n, parts in DIVERSITY.items()
    )
    picks = ", ".join(
        f"max(case when type = '{k}' then {n}_div end) as {k}_{n}_div" for n in DIVERSITY for k in ("res", "pow")
    )
    chg = ", ".join(f"pow_{n}_div - res_{n}_div as chg_{n}_div" for n in DIVERSITY)
    return f"{DIMENSION_SQL}, md as (select *, {chg} from (select unit_id, {picks} from (select unit_id, type, {divs} from dims) group by 1 having count(distinct type) = 2))"


MULTIDIM_SQL = _multidim_sql()
_MD_COLS = [f"{k}_{n}_div" for n in DIVERSITY for k in ("res", "pow", "chg")]


@query(
    "msr_multidim_diversity",
    with_ctes(f"with {MULTIDIM_SQL} select unit_id, " + ", ".join(f"{r6(c)} as {c}" for c in _MD_COLS) + " from md", "f10"),
)


def msr_multidim_diversity(spark, sf):
    return _rounded_all(multidim(spark, sf).select("unit_id", *_MD_COLS), _MD_COLS)


def _dis_join_sql() -> str:
    return " ".join(
        f"join {dissimilarity_sql('f3', 'metro_id, year', a, b)} as t_{name} on t_{name}.metro_id = u.metro_id and t_{name}.year = u.year"
        for name, (a, b) in PAIRS.items()
    )


@query(
    "msr_dissimilarity_window",
    with_ctes(
        f"with {_F3} select u.unit_id, u.metro_id, u.year, " + ", ".join(f"{r6(f't_{n}.d')} as {n}" for n in PAIRS) + f" from f3 u {_dis_join_sql()}",
        "f2",
    ),
)


def msr_dissimilarity_window(spark, sf):
    u = segregation.add_dissimilarity(with_totals(spark, sf), ["metro_id", "year"], PAIRS, ["unit_id"])
    return _rounded_all(u.select("unit_id", "metro_id", "year", *PAIRS), list(PAIRS))


def segregation_summary(spark, sf):
    return segregation.dissimilarity_summary(fx.eligible(spark, sf), "metro_id", "unit_id", SIDES, MINORITIES)


_SUMMARY_SQL = " union all ".join(
    f"""select metro_id, metro_name, year, '{seg}' as seg, '{side}' as type, metro_n, metro_group, metro_pop, d as dis from {dissimilarity_sql('el', 'metro_id, year', f'{p}_{g}_est', f'{p}_nhw_est')}
 join (select metro_id, metro_name, year, cast(count(distinct unit_id) as bigint) as metro_n, sum({p}_{g}_est) as metro_group, sum({p}_total_est) as metro_pop from el group by 1, 2, 3) using (metro_id, year)"""
    for side, p in SIDES.items()
    for seg, g in MINORITIES.items()
)


@query("msr_dissimilarity_summary", with_ctes(f"select * replace ({r6('dis')} as dis) from ({_SUMMARY_SQL})", "el"))
def msr_dissimilarity_summary(spark, sf):
    return segregation_summary(spark, sf).withColumn("dis", rounded("dis"))


@query(
    "msr_segregation_trend",
    with_ctes(f"select seg, type, year, cast(count(*) as bigint) as n, {r6('sum(dis * metro_group) / sum(metro_group)')} as mean from ({_SUMMARY_SQL}) group by 1, 2, 3", "el"),
)


def msr_segregation_trend(spark, sf):
    return (
        segregation_summary(spark, sf)
        .groupBy("seg", "type", "year")
        .agg(F.count(F.lit(1)).alias("n"), rounded(nulls.weighted_avg("dis", "metro_group")).alias("mean"))
    )


_H_GROUPS = ["nha", "nhb", "h", "nhw"]


def theil_sql(source: str, keys: str, cols: list[str]) -> str:
    """H per group as a derived table (keys, h), from its definition with group sums windowed."""
    t = " + ".join(cols)
    sums = ", ".join(f"sum({c}) over (partition by {keys}) as s_{i}" for i, c in enumerate(cols))
    local = entropy_sql([f"coalesce({c} / nullif(t, 0), 0e0)" for c in cols])
    overall = entropy_sql([f"(s_{i} / nullif(tt, 0))" for i in range(len(cols))])
    return f"""(select {keys}, sum(t * (e - ei)) / nullif(max(tt) * max(e), 0) as h from
 (select *, {local} as ei, {overall} as e from (select *, {sums}, {t} as t, sum({t}) over (partition by {keys}) as tt from {source})) group by {keys})"""


def isolation_sql(source: str, keys: str, x: str, y: str) -> str:
    return f"(select {keys}, sum(case when {x} + {y} = 0 then 0e0 else {x} * ({x} / nullif({x} + {y}, 0)) end) / nullif(sum({x}), 0) as xpx from {source} group by {keys})"


_NIGHT_H = [f"res_{g}_est" for g in _H_GROUPS]
_MINORITY = "(res_nhb_est + res_nha_est + res_h_est + res_nho_est)"


@query("msr_theil_multigroup", with_ctes(f"select metro_id, year, {r6('h')} as multi_theil_nhood from {theil_sql('ty', 'metro_id, year', _NIGHT_H)}", "ty"))
def msr_theil_multigroup(spark, sf):
    h = segregation.information_index(_NIGHT_H)
    return fx.typed(spark, sf).groupBy("metro_id", "year").agg(rounded(h).alias("multi_theil_nhood"))


@query("msr_isolation", with_ctes(f"select metro_id, year, {r6('xpx')} as iso_nhood from {isolation_sql('ty', 'metro_id, year', _MINORITY, 'res_nhw_est')}", "ty"))
def msr_isolation(spark, sf):
    minority = F.col("res_nhb_est") + F.col("res_nha_est") + F.col("res_h_est") + F.col("res_nho_est")
    return (
        fx.typed(spark, sf)
        .groupBy("metro_id", "year")
        .agg(rounded(segregation.isolation(minority, "res_nhw_est")).alias("iso_nhood"))
    )


def located(spark, sf, points=fx.points):
    p = points(spark, sf).select("unit_id", "x", "y")
    return joins.natural_join(fx.typed(spark, sf), p, "inner", ["unit_id"])


def spatial(spark, sf):
    return area_indices(located(spark, sf, fx.scattered), ["metro_id", "year"], "x", "y", BETA, RADIUS)


def spatial_whole(spark, sf):
    """Without a radius: every area of a metro is in the surroundings of every other."""
    return area_indices(located(spark, sf, fx.scattered), ["metro_id", "year"], "x", "y", BETA, error=1e-11)


def on_raster(spark, sf):
    return spatial_indices(located(spark, sf), ["metro_id", "year"], "x", "y", CELL, RADIUS, BETA)


def surroundings_sql(source: str = "ty", radius: float | None = RADIUS) -> str:
    """CTEs ``ar`` (areas), ``pr`` (pairs of areas of a metro) and ``env`` (weighted counts around each area); they need f6s."""
    sums = [*_H_GROUPS, "minority"]
    near = "" if radius is None else f" where d <= {radius}e0"
    return f"""ar as (select metro_id, year, unit_id, x, y, {", ".join(f"res_{g}_est as {g}" for g in _H_GROUPS)}, {_MINORITY} as minority from {source} s join f6s using (unit_id, metro_id)),
pr as (select * from (select p.metro_id, p.year, p.unit_id, q.unit_id as to_unit_id, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) as d, {", ".join(f"q.{g}" for g in sums)}
  from ar p join ar q on p.metro_id = q.metro_id and p.year = q.year){near}),
env as (select ar.*, {", ".join(f"e_{g}" for g in sums)} from ar join (select year, unit_id, {", ".join(f"sum({g} * exp(-{BETA}e0 * d)) as e_{g}" for g in sums)} from pr group by 1, 2) using (year, unit_id))
"""


SURFACE_SQL = f"""surf as (select metro_id, year, cast(floor(x / {CELL}e0) as bigint) as cx, cast(floor(y / {CELL}e0) as bigint) as cy,
  {", ".join(f"sum(res_{g}_est) as {g}" for g in _H_GROUPS)}, sum({_MINORITY}) as minority from (select ty.*, x, y from ty join f6 on ty.unit_id = f6.unit_id) group by 1, 2, 3, 4),
nb as (select p.metro_id, p.year, p.cx, p.cy, q.cx as to_cx, q.cy as to_cy, sqrt(cast((p.cx - q.cx) * (p.cx - q.cx) + (p.cy - q.cy) * (p.cy - q.cy) as double)) * {CELL}e0 as dist
  from surf p join surf q on p.metro_id = q.metro_id and p.year = q.year and sqrt(cast((p.cx - q.cx) * (p.cx - q.cx) + (p.cy - q.cy) * (p.cy - q.cy) as double)) * {CELL}e0 <= {RADIUS}e0),
env as (select p.*, {", ".join(f"e_{g}" for g in [*_H_GROUPS, "minority"])} from surf p join (select nb.metro_id, nb.year, nb.cx, nb.cy, {", ".join(f"sum(q.{g} * exp(-{BETA}e0 * dist)) as e_{g}" for g in [*_H_GROUPS, "minority"])}
  from nb join surf q on nb.metro_id = q.metro_id and nb.year = q.year and nb.to_cx = q.cx and nb.to_cy = q.cy group by 1, 2, 3, 4) e using (metro_id, year, cx, cy))
"""
_S_T = " + ".join(_H_GROUPS)
_S_ET = " + ".join(f"e_{g}" for g in _H_GROUPS)
_SPAT_H = f"""select metro_id, year, 1 - sum(t * ({entropy_sql([f"coalesce(e_{g} / nullif({_S_ET}, 0), 0e0)" for g in _H_GROUPS])})) / nullif(max(tt) * max({entropy_sql([f"(s_{g} / nullif(tt, 0))" for g in _H_GROUPS])}), 0) as h
 from (select *, {_S_T} as t, sum({_S_T}) over (partition by metro_id, year) as tt, {", ".join(f"sum({g}) over (partition by metro_id, year) as s_{g}" for g in _H_GROUPS)} from env) group by 1, 2"""


def _spat_iso(g: str) -> str:
    return f"sum({g} * coalesce(e_{g} / nullif(e_{g} + e_nhw, 0), 0e0)) / nullif(sum({g}), 0)"


@query("msr_spatial_theil", with_ctes(f"with {surroundings_sql(radius=None)} select metro_id, year, {r6('h')} as spat_multi_theil_nhood from ({_SPAT_H})", "ty", "f6s"))
def msr_spatial_theil(spark, sf):
    """From distances between all areas of a metro."""
    return spatial_whole(spark, sf).select("metro_id", "year", rounded("spat_multi_theil_nhood").alias("spat_multi_theil_nhood"))


@query("msr_spatial_theil_raster", with_ctes(f"with {SURFACE_SQL} select metro_id, year, {r6('h')} as spat_multi_theil_nhood from ({_SPAT_H})", "ty", "f6"))
def msr_spatial_theil_raster(spark, sf):
    return on_raster(spark, sf).select("metro_id", "year", rounded("spat_multi_theil_nhood").alias("spat_multi_theil_nhood"))


_ISO = {"spat_iso_nhood": "minority", "spat_iso_nhb_nhood": "nhb", "spat_iso_nha_nhood": "nha", "spat_iso_h_nhood": "h"}


_ISO_SQL = "select metro_id, year, " + ", ".join(f"{r6(_spat_iso(g))} as {n}" for n, g in _ISO.items()) + " from env group by 1, 2"


@query("msr_spatial_isolation", with_ctes(f"with {surroundings_sql()} {_ISO_SQL}", "ty", "f6s"))
def msr_spatial_isolation(spark, sf):
    return _rounded_all(spatial(spark, sf).select("metro_id", "year", *_ISO), list(_ISO))


@query("msr_spatial_isolation_raster", with_ctes(f"with {SURFACE_SQL} {_ISO_SQL}", "ty", "f6"))
def msr_spatial_isolation_raster(spark, sf):
    return _rounded_all(on_raster(spark, sf).select("metro_id", "year", *_ISO), list(_ISO))


@query(
    "msr_spatial_whole_metro",
    with_ctes(
        f"with {surroundings_sql(radius=None)}, iso as ({_ISO_SQL}) select iso.*, {r6('h')} as spat_multi_theil_nhood from iso join ({_SPAT_H}) using (metro_id, year)",
        "ty",
        "f6s",
    ),
)
def msr_spatial_whole_metro(spark, sf):
    """All spatial indices without a radius."""
    return _rounded_all(spatial_whole(spark, sf), [*_ISO, "spat_multi_theil_nhood"])


# One location per raster cell (the fixture's points lie on a lattice of that width), so the
# indices over areas, without any raster, are the same.
FINE_CELL, FINE_RADIUS, FINE_BETA = 0.005, 0.1, 30.0
_AREAS_SQL = f"""ar as (select metro_id, year, unit_id, x, y, {", ".join(f"res_{g}_est as {g}" for g in _H_GROUPS)}, {_MINORITY} as minority from (select ty.*, x, y from ty join f6 on ty.unit_id = f6.unit_id)),
pr as (select p.metro_id, p.year, p.unit_id, q.unit_id as other, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) as d from ar p join ar q on p.metro_id = q.metro_id and p.year = q.year),
env as (select ar.*, {", ".join(f"e_{g}" for g in [*_H_GROUPS, "minority"])} from ar join (select pr.year, pr.unit_id, {", ".join(f"sum(q.{g} * exp(-{FINE_BETA}e0 * d)) as e_{g}" for g in [*_H_GROUPS, "minority"])}
  from pr join ar q on pr.year = q.year and pr.other = q.unit_id where d <= {FINE_RADIUS}e0 + 1e-9 group by 1, 2) using (year, unit_id))
"""


@query(
    "msr_spatial_areas",
    with_ctes(
        f"with {_AREAS_SQL}, iso as (select metro_id, year, " + ", ".join(f"{r6(_spat_iso(g))} as {n}" for n, g in _ISO.items())
        + f" from env group by 1, 2) select iso.*, {r6('h')} as spat_multi_theil_nhood from iso join ({_SPAT_H}) using (metro_id, year)",
        "ty",
        "f6",
    ),
)
def msr_spatial_areas(spark, sf):
    """The spatial indices on a fine raster, checked against sums over pairs of areas."""
    s = spatial_indices(located(spark, sf), ["metro_id", "year"], "x", "y", FINE_CELL, FINE_RADIUS, FINE_BETA)
    return _rounded_all(s, [*_ISO, "spat_multi_theil_nhood"])


def metro_panel(spark, sf, spatially: bool = True, metro_medians: bool = True):
    """The full metro panel: one aggregation, exact medians, spatial indices, D on all areas."""
    keys = ["metro_id", "metro_name", "year"]
    d = segregation.dissimilarity(with_totals(spark, sf), ["metro_id", "year"], PAIRS, ["unit_id"])
    u = with_entropy(settle(fx.eligible(spark, sf)))
    u = u.withColumn("trt_tot_for_born", F.col("res_h_est") + F.col("res_nha_est"))
    panel = joins.natural_join(segregation.metro_panel(u, keys), d, "left", ["metro_id", "year"])
    if metro_medians:
        chg = [f"chg_{g}" for g in ("nhw", "nhb", "nha", "h")]
        panel = joins.natural_join(panel, order.medians(u, keys, chg, "med_"), "left", keys)
    if spatially:
        p = fx.scattered(spark, sf).select("unit_id", "x", "y")
        xy = joins.natural_join(u, p, "inner", ["unit_id"])
        s = area_indices(xy, ["metro_id", "year"], "x", "y", BETA, RADIUS)
        panel = joins.natural_join(panel, s, "left", ["metro_id", "year"])
    return panel


def panel_sql(spatially: bool = True) -> str:
    """CTE text ending with table ``panel``; needs el (and f6s when spatial)."""
    parts = [*GROUPS, "for_born", "suburb"]
    name = {"suburb": "sub"}
    base = f"""select metro_id, metro_name, year, cast(count(*) as bigint) as n_tract,
  {", ".join(f"avg(race_eth_div_{s}) as avg_div_{w}, avg(case when prin_city then race_eth_div_{s} end) as avg_div_{w}_city, avg(case when not prin_city then race_eth_div_{s} end) as avg_div_{w}_sub, cast(count(case when {s}_cat = 'Multiethnic' then 1 end) as bigint) as n_div_{w}" for w, s in [("whood", "am"), ("nhood", "pm")])},
  max(state) as state, sum(res_total_est) as tot_pop, log10(sum(res_total_est)) as log_pop, {", ".join(f"sum(res_{g}_est) as tot_{g}" for g in GROUPS)},
  sum(res_h_est + res_nha_est) as tot_for_born, coalesce(sum(case when not prin_city then res_total_est end), 0) as tot_suburb,
  {", ".join(f"avg(chg_{g}) as avg_chg_{g}, median(chg_{g}) as med_chg_{g}" for g in ("nhw", "nhb", "nha", "h"))} from ent group by 1, 2, 3"""
    ratios = ", ".join(f"tot_{p} / nullif(tot_pop, 0) as met_shr_{name.get(p, p)}" for p in parts)
    divs = ", ".join(
        f"cast(n_div_{w} as double) / n_tract as shr_div_{w}, 1 - cast(n_div_{w} as double) / n_tract as shr_non_div_{w}" for w in ("whood", "nhood")
    )
    joins_ = f"join {theil_sql('ent', 'metro_id, year', _NIGHT_H)} th using (metro_id, year) join {isolation_sql('ent', 'metro_id, year', _MINORITY, 'res_nhw_est')} iso using (metro_id, year)"
    extra = "h as multi_theil_nhood, xpx as iso_nhood"
    for n, (a, b) in PAIRS.items():
        joins_ += f" join (select metro_id, year, d as {n} from {dissimilarity_sql('f3', 'metro_id, year', a, b)}) using (metro_id, year)"
    ctes = f"{_F3}, ent as {_entropy_cols('el')}, "
    if spatially:
        ctes += surroundings_sql("el") + ", "
        joins_ += f" join (select metro_id, year, h as spat_multi_theil_nhood from ({_SPAT_H})) using (metro_id, year)"
        joins_ += " join (select metro_id, year, " + ", ".join(f"{_spat_iso(g)} as {n}" for n, g in _ISO.items()) + " from env group by 1, 2) using (metro_id, year)"
    return f"{ctes} panel as (select * exclude (h, xpx), {extra}, {ratios}, {divs} from ({base}) {joins_})"


_PANEL_ROUND = [
    *[f"avg_div_{w}{x}" for w in ("whood", "nhood") for x in ("", "_city", "_sub")],
    "multi_theil_nhood",
    "iso_nhood",
    "spat_multi_theil_nhood",
    *_ISO,
    "log_pop",
    *[f"{a}_chg_{g}" for a in ("avg", "med") for g in ("nhw", "nhb", "nha", "h")],
    *PAIRS,
    *[f"met_shr_{g}" for g in (*GROUPS, "for_born", "sub")],
    *[f"shr_{x}div_{w}" for x in ("", "non_") for w in ("whood", "nhood")],
]


@query(
    "msr_metro_summary",
    with_ctes(f"with {panel_sql()} select * replace (" + ", ".join(f"{r6(c)} as {c}" for c in _PANEL_ROUND) + ") from panel", "el", "f6s"),
)


def msr_metro_summary(spark, sf):
    return _rounded_all(metro_panel(spark, sf), _PANEL_ROUND)


@query(
    "msr_metro_eligibility",
    with_ctes("select metro_id, year, cast(count(*) as bigint) as n_units, sum(res_total_est) as workers from el group by 1, 2", "el"),
)


def msr_metro_eligibility(spark, sf):
    return (
        fx.eligible(spark, sf)
        .groupBy("metro_id", "year")
        .agg(F.count(F.lit(1)).alias("n_units"), F.sum("res_total_est").alias("workers"))
    )


@query(
    "msr_rank_change",
    with_ctes(
        f"""with ent as {_entropy_cols('ty')}, m as (select metro_id, metro_name, sum(res_total_est) as tot_pop, avg(race_eth_div_am) as dw, avg(race_eth_div_pm) as dn from ent where year = '2012-2016 ACS' group by 1, 2),
 t as (select * from (select *, rank() over (order by tot_pop desc) as r from m) where r <= 10),
 k as (select *, rank() over (order by dw desc) + (count(*) over (partition by dw) - 1) / 2e0 as whood_div_rank, rank() over (order by dn desc) + (count(*) over (partition by dn) - 1) / 2e0 as nhood_div_rank from t)
 select metro_name, whood_div_rank - nhood_div_rank as chg_rank, {r6('dn')} as avg_div_nhood, {r6('dw')} as avg_div_whood, whood_div_rank, nhood_div_rank from k""",
        "ty",
    ),
)


def msr_rank_change(spark, sf):
    last = with_entropy(fx.typed(spark, sf)).filter(F.col("year") == "2012-2016 ACS")
    metros = last.groupBy("metro_id", "metro_name").agg(
        F.sum("res_total_est").alias("tot_pop"),
        F.avg("race_eth_div_am").alias("avg_div_whood"),
        F.avg("race_eth_div_pm").alias("avg_div_nhood"),
    )
    top = settle(order.top_with_ties(settle(metros), 10, "tot_pop"))
    for w in ("whood", "nhood"):
        top = order.add_rank(top, [], f"avg_div_{w}", f"{w}_div_rank", descending=True)
    return top.select(
        "metro_name",
        (F.col("whood_div_rank") - F.col("nhood_div_rank")).alias("chg_rank"),
        rounded("avg_div_nhood").alias("avg_div_nhood"),
        rounded("avg_div_whood").alias("avg_div_whood"),
        "whood_div_rank",
        "nhood_div_rank",
    )


_COUNTS = [f"{p}_{g}_est" for p in ("res", "pow") for g in ("total", *GROUPS)]


@query(
    "msr_crosswalk_realloc",
    with_ctes(
        "select m.*, c_nationkey as metro_id from (select to_id as unit_id, year, " + ", ".join(f"sum({c} * weight) as {c}" for c in _COUNTS) + " from f2 join f4 on unit_id = from_id where year = '2000' and to_id is not null group by 1, 2) m left join customer on c_custkey = m.unit_id",
        "f2",
        "f4",
    ),
)


def msr_crosswalk_realloc(spark, sf):
    base = fx.units(spark, sf).filter(F.col("year") == "2000")
    moved = segregation.reallocate(base, fx.crosswalk(spark, sf), "unit_id", "from_id", "to_id", "weight", _COUNTS)
    ids = fx.places(spark, sf).select("unit_id", "metro_id")
    return joins.natural_join(moved, ids, "left", ["unit_id"])


_EARN_TOTAL = " + ".join(f"earn_{b}" for b in EARN_BANDS)
@query(
    "msr_earnings_profile",
    with_ctes(
        f"""with {BRACKET_SQL}, w as (select unit_id, type, {", ".join(f"sum(case when band = '{b}' then value end) as earn_{b}" for b in EARN_BANDS)} from br group by 1, 2),
 s as (select *, {_EARN_TOTAL} as tot_workers, {", ".join(f"earn_{b} / nullif({_EARN_TOTAL}, 0) as shr_earn_{b}" for b in EARN_BANDS)} from w)
 select * replace ({", ".join(f"{r6(c)} as {c}" for c in EARN_SHARES)}), {r6(entropy_sql(EARN_SHARES))} as earn_div from s""",
        "f9",
    ),
)


def msr_earnings_profile(spark, sf):
    out = earnings_profile(fx.earnings(spark, sf), ["unit_id", "type"])
    return _rounded_all(out, [*EARN_SHARES, "earn_div"])


_PUMS_ROUND = ["med_hh_inc", "mean_occ_inc_score", "mean_sei", "pop_shr", "shr_for_born", "inc_ratio", "occ_score_ratio", "sei_ratio"]


def _vs_white(c: str) -> str:
    return f"{c} / nullif(max(case when race_eth = 'NL White' then {c} end) over (partition by met_id, year), 0)"


@query(
    "msr_pums_panel",
    with_ctes(
        f"""with p as (select *, {_RACE} as race_eth, case yr when 2000 then '2000' when 2010 then '2006-2010 ACS' when 2016 then '2012-2016 ACS' end as year from f7 where met_id <> 0),
 a as (select met_id, year, race_eth, cast(sum(perwt) as bigint) as tot_pop, cast(sum(case when bpl between 1 and 99 then 0 else perwt end) as bigint) as tot_for_born,
   cast(sum(occscore * perwt) as double) / sum(perwt) as mean_occ_inc_score, cast(sum(sei * perwt) as double) / sum(perwt) as mean_sei from p group by 1, 2, 3),
 e as (select a.*, wmed as med_hh_inc from a left join {weighted_median_sql('p', 'met_id, year, race_eth', 'hhincome', 'hhwt')} m on a.met_id = m.met_id and a.year = m.year and a.race_eth = m.race_eth)
 select met_id, year, race_eth, tot_pop, tot_for_born, {r6('med_hh_inc')} as med_hh_inc, {r6('mean_occ_inc_score')} as mean_occ_inc_score, {r6('mean_sei')} as mean_sei,
  {r6('cast(tot_pop as double) / sum(tot_pop) over (partition by met_id, year)')} as pop_shr, {r6('cast(tot_for_born as double) / tot_pop')} as shr_for_born,
  {r6(_vs_white('med_hh_inc'))} as inc_ratio, {r6(_vs_white('mean_occ_inc_score'))} as occ_score_ratio, {r6(_vs_white('mean_sei'))} as sei_ratio from e""",
        "f7",
    ),
)


def msr_pums_panel(spark, sf):
    return _rounded_all(person_panel(fx.persons(spark, sf)), _PUMS_ROUND)


@query(
    "msr_od_flows",
    with_ctes(
        """with ends as (select unit_id as id, metro_id, x, y from f6), last as (select unit_id, pm_cat, am_cat from ty where year = '2012-2016 ACS'),
 j as (select res_id, pow_id, h.metro_id as res_metro_id, w.metro_id as pow_metro_id, h.x as res_x, h.y as res_y, w.x as pow_x, w.y as pow_y, t.pm_cat, t.am_cat, concat(c.pm_cat, ' (PM)') as cat, nhw_est, oth_est
  from f8 join ends h on res_id = h.id join ends w on pow_id = w.id and w.metro_id = h.metro_id left join last t on res_id = t.unit_id join last c on pow_id = c.unit_id)
 select * exclude (nhw_est, oth_est), 'nhw_est' as name, nhw_est as value, 'Workers who are Non-Hispanic Whites' as est_type from j where nhw_est >= 1
 union all select * exclude (nhw_est, oth_est), 'oth_est', oth_est, 'Workers who are not Non-Hispanic Whites' from j where oth_est >= 1""",
        "f6",
        "f8",
        "ty",
    ),
)


def msr_od_flows(spark, sf):
    ends = fx.points(spark, sf).withColumnRenamed("unit_id", "id")
    last = fx.typed(spark, sf).filter(F.col("year") == "2012-2016 ACS")
    home = last.select(F.col("unit_id").alias("res_id"), "pm_cat", "am_cat")
    work = last.select(F.col("unit_id").alias("pow_id"), F.concat("pm_cat", F.lit(" (PM)")).alias("cat"))
    return od_flows(fx.flows(spark, sf), ends, home, work)


@query(
    "msr_flow_build",
    with_ctes(
        """with ok as (select * from f5 where trt_string not like 'Tract 999999%'),
 ends as (select 'G' || cast(f6.unit_id as varchar) as GISJOIN, trt_string, metro_id, x, y, f6.unit_id from f6 join ok on f6.unit_id = ok.unit_id),
 last as (select unit_id, pm_cat, am_cat from ty where year = '2012-2016 ACS'),
 fl as (select h.trt_string as rl, w.trt_string as pl, nhw_est, oth_est from f8 join ok h on res_id = h.unit_id join ok w on pow_id = w.unit_id),
 j as (select h.GISJOIN as res_GISJOIN, w.GISJOIN as pow_GISJOIN, h.metro_id as res_metro_id, w.metro_id as pow_metro_id, h.x as res_x, h.y as res_y, w.x as pow_x, w.y as pow_y, t.pm_cat, t.am_cat, concat(c.pm_cat, ' (PM)') as cat, nhw_est, oth_est
  from fl join ends h on rl = h.trt_string join ends w on pl = w.trt_string and w.metro_id = h.metro_id left join (select * from last join ends using (unit_id)) t on rl = t.trt_string join (select * from last join ends using (unit_id)) c on pl = c.trt_string)
 select * exclude (nhw_est, oth_est), 'nhw_est' as name, nhw_est as value, 'Workers who are Non-Hispanic Whites' as est_type from j where nhw_est >= 1
 union all select * exclude (nhw_est, oth_est), 'oth_est', oth_est, 'Workers who are not Non-Hispanic Whites' from j where oth_est >= 1""",
        "f5",
        "f6",
        "f8",
        "ty",
    ),
)
def msr_flow_build(spark, sf):
    """Headerless flow files with two label columns, through to typed flows inside metros."""
    labels = settle(fx.labels(spark, sf).filter(~F.col("trt_string").startswith("Tract 999999")))
    path = write_flow_files(spark, fx.flows(spark, sf), labels)
    schema = "res_tract_str string, pow_tract_str string, total_est double, nhw_est double, oth_est double"
    raw = extracts.read_extracts(spark, path, schema, F.lit(6), header=False).drop("file")
    gisjoin = F.concat(F.lit("G"), F.col("unit_id").cast("string")).alias("GISJOIN")
    points = joins.natural_join(fx.points(spark, sf), labels, "inner", ["unit_id"])
    parsed = points.select(gisjoin, "metro_id", parse_tract_label("trt_string").alias("p"))
    tracts = parsed.select("GISJOIN", "metro_id", "p.tractfp", "p.countylsad", "p.state")
    last = fx.typed(spark, sf).filter(F.col("year") == "2012-2016 ACS")
    return flow_build(raw, tracts, points.select(gisjoin, "x", "y"), last.select(gisjoin, "pm_cat", "am_cat"))


@query(
    "msr_metro_layers",
    with_ctes(
        f"""with {_TY9}, u as (select *, res_total_est + pow_total_est as trt_tot_pop, 'Place ' || cast(unit_id % 4 as varchar) as place_name from ty9),
 m as (select metro_id from (select metro_id, rank() over (order by sum(trt_tot_pop) desc) as r from u where year = '2012-2016 ACS' group by 1) where r <= 10),
 r as (select * from u where year in ('2000', '2012-2016 ACS') and metro_id in (select metro_id from m)),
 p as (select metro_id, place_name from (select metro_id, place_name, rank() over (partition by metro_id order by sum(trt_tot_pop) desc) as k from r where prin_city group by 1, 2) where k = 1)
 select r.unit_id, r.metro_id, r.year, {_PREDOM_SQL} as predom_pm_am, {_MULT_SQL} as mult_pm_am, lower(regexp_replace(metro_name, ' |/', '_', 'g')) as slug, r.place_name, p.place_name is not null as in_largest_place
 from r left join p on r.metro_id = p.metro_id and r.place_name = p.place_name""",
        "ty",
    ),
)


def msr_metro_layers(spark, sf):
    u = settle(typed9(spark, sf)).withColumns(
        {
            "trt_tot_pop": F.col("res_total_est") + F.col("pow_total_est"),
            "place_name": F.concat(F.lit("Place "), (F.col("unit_id") % 4).cast("string")),
        }
    )
    cols = ["unit_id", "metro_id", "year", "predom_pm_am", "mult_pm_am", "slug", "place_name", "in_largest_place"]
    return metro_layers(u, 10).select(*cols)
