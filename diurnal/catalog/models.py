"""Queries: linear models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.composition import GROUPS, PERIODS
from ..functions.nulls import rounded
from ..functions.shapes import area, edges
from ..functions.text import cross_label, split_piece
from ..operators import cells, joins, regression, reshape
from ..operators.regression import Spec
from ..plans.analyses import with_entropy
from ..session import settle
from . import fixtures as fx
from .fixtures import r6, with_ctes
from .measures import MULTIDIM_SQL, _entropy_cols, metro_panel, multidim, panel_sql
from .registry import query

OUTCOMES = [f"chg_{g}" for g in GROUPS]
# Outcome -> readable group.
GROUP_LABELS = {
    "chg_nhw": "NL White",
    "chg_nhb": "NL Black",
    "chg_h": "Latinx",
    "chg_nha": "NL Asian",
    "chg_nho": "NL Other",
}
BASE_TYPE, BASE_PERIOD = "Multiethnic", "2000"

# outcome -> it is unknown where this divides the area's number; each outcome is a model of its own
UNKNOWN = {"chg_nha": 11, "chg_h": 13, "res_total_est": 7}


def modelled(spark, sf):
    """Eligible areas, single outcomes unknown here and there."""
    u = fx.eligible(spark, sf)
    return u.withColumns({c: F.when(F.col("unit_id") % d != 0, F.col(c)) for c, d in UNKNOWN.items()})


_LONG = "lo as (" + " union all ".join(f"select '{c}' as outcome, unit_id, metro_id, prin_city, pm_cat, year, {c} as v from el" + (f" where unit_id % {UNKNOWN[c]} <> 0" if c in UNKNOWN else "") for c in OUTCOMES) + ")"


def _cells_sql(cell: str) -> str:
    """CTEs: mc (cell means), sg (cluster residual sums per cell), fa (small-sample factor)."""
    return f"""{_LONG}, mc as (select outcome, {cell}, count(*) as n, avg(v) as m from lo group by all),
 sg as (select outcome, {cell}, unit_id, sum(u) as s from (select *, v - avg(v) over (partition by outcome, {cell}) as u from lo) group by all),
 fa as (select outcome, (g / (g - 1e0)) * ((nobs - 1e0) / (nobs - k)) as f from (select outcome, count(*) as nobs, count(distinct unit_id) as g, count(distinct ({cell})) as k from lo group by 1))"""


_BASE = f"pm_cat = '{BASE_TYPE}'"
_TERM = f"case when pm_cat = '{BASE_TYPE}' and year = '2000' then '(Intercept)' when year = '2000' then 'pm_cat' || pm_cat when pm_cat = '{BASE_TYPE}' then 'year' || year else 'pm_cat' || pm_cat || ':year' || year end"
_COEF_SQL = f"""select mc.outcome, {_TERM.replace('pm_cat =', 'mc.pm_cat =').replace("|| pm_cat", "|| mc.pm_cat").replace('year =', 'mc.year =').replace("|| year", "|| mc.year")} as term,
  case when mc.{_BASE} and mc.year = '2000' then mc.m when mc.{_BASE} or mc.year = '2000' then mc.m - b.m else mc.m - ra.m - rb.m + b.m end as estimate
 from mc join (select outcome, m from mc where {_BASE} and year = '2000') b on mc.outcome = b.outcome
 left join (select outcome, pm_cat, m from mc where year = '2000') ra on mc.outcome = ra.outcome and mc.pm_cat = ra.pm_cat
 left join (select outcome, year, m from mc where {_BASE}) rb on mc.outcome = rb.outcome and mc.year = rb.year"""


@query(
    "mdl_ols_factor_interaction",
    with_ctes(f"with {_cells_sql('pm_cat, year')} select outcome, term, {r6('estimate')} as estimate from ({_COEF_SQL})", "el"),
)
def mdl_ols_factor_interaction(spark, sf):
    out = cells.interaction_coefficients(
        modelled(spark, sf), OUTCOMES, "pm_cat", "year", BASE_TYPE, BASE_PERIOD
    )
    return out.withColumn("estimate", rounded("estimate"))


@query(
    "mdl_cluster_se",
    with_ctes(
        f"""with {_cells_sql('pm_cat, year')}, ct as (select a.pm_cat, a.year, t.pm_cat as tp, t.year as tyr, (case when a.{_BASE} and t.pm_cat <> '{BASE_TYPE}' then -1 else 1 end) * (case when a.year = '2000' and t.year <> '2000' then -1 else 1 end) as sgn
   from (select distinct pm_cat, year from mc) a, (select distinct pm_cat, year from mc) t where (a.{_BASE} or a.pm_cat = t.pm_cat) and (a.year = '2000' or a.year = t.year)),
 sc as (select sg.outcome, tp as pm_cat, tyr as year, sg.unit_id, sum(sgn * s / n) as s from sg join mc on sg.outcome = mc.outcome and sg.pm_cat = mc.pm_cat and sg.year = mc.year join ct on ct.pm_cat = sg.pm_cat and ct.year = sg.year group by all),
 me as (select outcome, {_TERM} as term, sum(s * s) as meat from sc group by all)
 select c.outcome, c.term, {r6('estimate')} as estimate, {r6('sqrt(f * meat)')} as se from ({_COEF_SQL}) c join me on c.outcome = me.outcome and c.term = me.term join fa on fa.outcome = c.outcome""",
        "el",
    ),
)
def mdl_cluster_se(spark, sf):
    out = cells.interaction_cluster_se(
        modelled(spark, sf), OUTCOMES, "pm_cat", "year", BASE_TYPE, BASE_PERIOD, "unit_id"
    )
    return reshape.across(out, ["estimate", "se"], rounded)


def readable_margins(df):
    """Margins with group names and the type label used in figures."""
    names = F.create_map(*[F.lit(x) for pair in GROUP_LABELS.items() for x in pair])
    df = df.withColumns(
        {
            "race_eth": F.try_element_at(names, F.col("outcome")),
            "pm_cat": F.concat(F.lit("Nighttime:\n"), "pm_cat"),
        }
    )
    return reshape.across(df.drop("outcome", "n"), ["pred", "se", "lower", "upper"], rounded)


def _margins_sql(cell: str, where: str = "true") -> str:
    names = " ".join(f"when '{k}' then '{v}'" for k, v in GROUP_LABELS.items())
    cols = ", ".join(c if c != "pm_cat" else "'Nighttime:' || chr(10) || pm_cat as pm_cat" for c in cell.split(", "))
    on = " and ".join(f"mc.{c} = x.{c}" for c in ["outcome", *cell.split(", ")])
    return f"""with {_cells_sql(cell)}, r as (select mc.*, sqrt(f * x.meat) / n as se from mc join (select outcome, {cell}, sum(s * s) as meat from sg group by all) x on {on} join fa on fa.outcome = mc.outcome)
 select case outcome {names} end as race_eth, {cols}, {r6('m')} as pred, {r6('se')} as se, {r6('m - 1.959964e0 * se')} as lower, {r6('m + 1.959964e0 * se')} as upper from r where {where}"""


@query("mdl_margins", with_ctes(_margins_sql("pm_cat, year"), "el"))
def mdl_margins(spark, sf):
    return readable_margins(cells.margins(modelled(spark, sf), OUTCOMES, ["pm_cat", "year"], "unit_id"))


@query("mdl_margins_city_sub", with_ctes(_margins_sql("prin_city, pm_cat, year"), "el"))
def mdl_margins_city_sub(spark, sf):
    keys = ["prin_city", "pm_cat", "year"]
    return readable_margins(cells.margins(modelled(spark, sf), OUTCOMES, keys, "unit_id"))


# Type families shown together.
FAMILY = ["Predominantly Black", "Predominantly Latinx", "Predominantly Asian"]


@query(
    "mdl_margins_subsets",
    with_ctes(
        _margins_sql("pm_cat, year", "pm_cat in (" + ", ".join(f"'{t}'" for t in FAMILY) + ") and year in ('2000', '2012-2016 ACS')"),
        "el",
    ),
)
def mdl_margins_subsets(spark, sf):
    m = cells.margins(modelled(spark, sf), OUTCOMES, ["pm_cat", "year"], "unit_id")
    return readable_margins(
        m.filter(F.col("pm_cat").isin(*FAMILY) & F.col("year").isin("2000", "2012-2016 ACS"))
    )


@query(
    "mdl_glm_gaussian_predict",
    with_ctes(
        f"select pm_cat, 'Neighborhood' as name, {r6('avg(case when unit_id % 7 <> 0 then res_total_est end)')} as value from el group by 1 union all select pm_cat, 'Workhood', {r6('avg(pow_total_est)')} from el group by 1",
        "el",
    ),
)
def mdl_glm_gaussian_predict(spark, sf):
    means = cells.cell_means(modelled(spark, sf), ["res_total_est", "pow_total_est"], ["pm_cat"])
    name = F.when(F.col("outcome") == "res_total_est", "Neighborhood").otherwise("Workhood")
    return means.select("pm_cat", name.alias("name"), rounded("mean").alias("value"))


# Outcome -> title of the predictions.
HETEROGENEITY = {
    "chg_age_div": "Age Heterogeneity",
    "chg_sex_div": "Sex Heterogeneity",
    "chg_lang_div": "Language Heterogeneity",
    "chg_inc_div": "Income Heterogeneity",
}


def multidim_typed(spark, sf):
    """Areas of the last period with changes in all kinds of diversity."""
    last = with_entropy(fx.typed(spark, sf)).filter(F.col("year") == PERIODS[2])
    last = last.withColumn("chg_race_eth_div", F.col("race_eth_div_am") - F.col("race_eth_div_pm"))
    return joins.natural_join(multidim(spark, sf), last, "inner", ["unit_id"])


_MD_TYPED = f"{MULTIDIM_SQL}, mt as (select md.*, am_cat, pm_cat, am_cat || ':' || pm_cat as am_pm_cat from md join ty on md.unit_id = ty.unit_id where year = '{PERIODS[2]}')"
_MD_LONG = "lo as (" + " union all ".join(f"select '{t}' as model, am_pm_cat, {c} as v from mt" for c, t in HETEROGENEITY.items()) + ")"


@query(
    "mdl_cross_type_predict",
    with_ctes(
        f"""with {_MD_TYPED}, {_MD_LONG}, g as (select model, am_pm_cat, count(v) as n, avg(v) as m, sum(r * r) as ss from (select *, v - avg(v) over (partition by model, am_pm_cat) as r from lo where v is not null) group by all),
 p as (select model, sum(ss) / (sum(n) - count(*)) as s2 from g group by 1)
 select g.model, split_part(am_pm_cat, ':', 1) as am_cat, split_part(am_pm_cat, ':', 2) as pm_cat, cast(n as bigint) as n, {r6('m')} as predicted, {r6('sqrt(s2 / n)')} as se from g join p on g.model = p.model""",
        "f10",
        "ty",
    ),
)
def mdl_cross_type_predict(spark, sf):
    t = multidim_typed(spark, sf).withColumn("am_pm_cat", cross_label("am_cat", "pm_cat"))
    pred = cells.group_predictions(t, list(HETEROGENEITY), ["am_pm_cat"])
    names = F.create_map(*[F.lit(x) for pair in HETEROGENEITY.items() for x in pair])
    return pred.select(
        F.try_element_at(names, F.col("outcome")).alias("model"),
        split_piece("am_pm_cat", ":", 2, 1).alias("am_cat"),
        split_piece("am_pm_cat", ":", 2, 2).alias("pm_cat"),
        "n",
        rounded("pred").alias("predicted"),
        rounded("se").alias("se"),
    )


def _fe2_sql(source: str, y: str, x1: str, x2: str, group: str, model: str, names: tuple[str, str], se: bool = True) -> str:
    """Two regressors and one absorbed effect by Cramer's rule, clustered by the effect."""
    dm = lambda c: f"{c} - avg({c}) over (partition by {group})"
    tail = lambda j: (
        f", {r6(f'se{j}')} as se, {r6(f'b{j} / se{j}')} as t, cast(n as bigint) as n, {r6('1 - rss / syy')} as r2" if se else ""
    )
    return f"""(with d as (select {group} as g, {dm(y)} as y, {dm(x1)} as x1, {dm(x2)} as x2 from {source} where {y} is not null and {x1} is not null and {x2} is not null),
  s as (select sum(x1*x1) as a, sum(x1*x2) as b, sum(x2*x2) as c, sum(x1*y) as p, sum(x2*y) as q, sum(y*y) as syy, count(*) as n, count(distinct g) as gg from d),
  e as (select *, (p*c - q*b) / (a*c - b*b) as b1, (a*q - b*p) / (a*c - b*b) as b2 from s),
  u as (select g, sum(x1 * r) as u1, sum(x2 * r) as u2, sum(r * r) as rr from (select d.*, y - e.b1 * x1 - e.b2 * x2 as r from d, e) group by 1),
  m as (select sum(u1*u1) as m11, sum(u1*u2) as m12, sum(u2*u2) as m22, sum(rr) as rss from u),
  v as (select e.*, m.rss, a*c - b*b as det, m11, m12, m22, (gg / (gg - 1e0)) * ((n - 1e0) / (n - 3e0)) as f from e, m),
  w as (select *, sqrt(f * (c*c*m11 - 2*c*b*m12 + b*b*m22)) / det as se1, sqrt(f * (b*b*m11 - 2*a*b*m12 + a*a*m22)) / det as se2 from v)
 select '{model}' as model, '{y}' as outcome, '{names[0]}' as term, {r6('b1')} as estimate{tail(1)} from w union all select '{model}', '{y}', '{names[1]}', {r6('b2')}{tail(2).replace(' as se', '').replace(' as t', '').replace(' as n', '').replace(' as r2', '')} from w)"""


def _with_logs(units):
    return units.withColumn("log_night", F.ln("res_total_est"))


_LOGGED = "lg as (select *, ln(res_total_est) as log_night from el)"
_FE_TERMS = ("trt_shr_nhw_pm", "log_night")


def _round_fit(df, columns=("estimate", "se", "t", "r2")):
    return reshape.across(df, list(columns), rounded)


@query(
    "mdl_fe_ols",
    with_ctes(
        f"with {_LOGGED} select * from {_fe2_sql('lg', 'chg_nhb', *_FE_TERMS, 'metro_id', 'chg_nhb', _FE_TERMS, se=False)} union all select * from {_fe2_sql('lg', 'chg_nhw', *_FE_TERMS, 'metro_id', 'chg_nhw', _FE_TERMS, se=False)}",
        "el",
    ),
)
def mdl_fe_ols(spark, sf):
    u = settle(_with_logs(fx.eligible(spark, sf)).select("metro_id", "chg_nhb", "chg_nhw", *_FE_TERMS))
    fits = [regression.fit(u, Spec(y, _FE_TERMS, "metro_id")) for y in ("chg_nhb", "chg_nhw")]
    return _round_fit(reshape.stack(*fits).select("model", "outcome", "term", "estimate"), ["estimate"])


@query(
    "mdl_fe_cluster_se",
    with_ctes(f"with {_LOGGED} select * from {_fe2_sql('lg', 'chg_nhb', *_FE_TERMS, 'metro_id', 'chg_nhb', _FE_TERMS)}", "el"),
)
def mdl_fe_cluster_se(spark, sf):
    return _round_fit(regression.fit(_with_logs(fx.eligible(spark, sf)), Spec("chg_nhb", _FE_TERMS, "metro_id")))


@query(
    "mdl_wls_fe",
    with_ctes(
        f"""with d as (select metro_id as g, res_total_est as w, chg_nhb - sum(chg_nhb * res_total_est) over (partition by metro_id) / sum(res_total_est) over (partition by metro_id) as y,
   trt_shr_nhw_pm - sum(trt_shr_nhw_pm * res_total_est) over (partition by metro_id) / sum(res_total_est) over (partition by metro_id) as x from el),
 s as (select sum(w*x*y) / sum(w*x*x) as b, sum(w*x*x) as sxx, sum(w*y*y) as syy, sum(w*x*y) as sxy, count(*) as n, count(distinct g) as gg from d),
 u as (select g, sum(w * x * (y - b * x)) as u from d, s group by 1),
 r as (select s.*, sqrt((gg / (gg - 1e0)) * ((n - 1e0) / (n - 2e0)) * (select sum(u*u) from u)) / sxx as se from s)
 select 'chg_nhb' as model, 'chg_nhb' as outcome, 'trt_shr_nhw_pm' as term, {r6('b')} as estimate, {r6('se')} as se, {r6('b / se')} as t, cast(n as bigint) as n, {r6('b * sxy / syy')} as r2 from r""",
        "el",
    ),
)
def mdl_wls_fe(spark, sf):
    spec = Spec("chg_nhb", ["trt_shr_nhw_pm"], "metro_id", weight="res_total_est")
    return _round_fit(regression.fit(fx.eligible(spark, sf), spec))


def _small_panel(spark, sf):
    """Metro panel with period dummies, written once since several models read it."""
    panel = settle(metro_panel(spark, sf, spatially=False, metro_medians=False))
    return regression.period_dummies(panel, "year", PERIODS)


_DUMMY_PANEL = f"{panel_sql(spatially=False)}, pd as (select *, cast(year = '{PERIODS[1]}' as int) * 1e0 as y10, cast(year = '{PERIODS[2]}' as int) * 1e0 as y16 from panel)"
_YEAR_TERMS = (f"year{PERIODS[1]}", f"year{PERIODS[2]}")


@query(
    "mdl_ols_plain",
    with_ctes(
        f"""with {_DUMMY_PANEL}, c as (select year, count(*) as n, avg(avg_div_whood) as m, sum(r * r) as ss from (select *, avg_div_whood - avg(avg_div_whood) over (partition by year) as r from pd) group by 1),
 t as (select sum(ss) / (sum(n) - 3e0) as s2, cast(sum(n) as bigint) as nn, sum(ss) as rss, (select sum(pow(avg_div_whood - (select avg(avg_div_whood) from pd), 2)) from pd) as tss from c),
 b as (select n as n0, m as m0 from c where year = '2000'),
 r as (select '(Intercept)' as term, m0 as estimate, sqrt(s2 / n0) as se, nn, rss, tss from b, t union all select 'year' || year, m - m0, sqrt(s2 * (1e0 / n + 1e0 / n0)), nn, rss, tss from c, b, t where year <> '2000')
 select 'avg_div_whood' as model, 'avg_div_whood' as outcome, term, {r6('estimate')} as estimate, {r6('se')} as se, {r6('estimate / se')} as t, nn as n, {r6('1 - rss / tss')} as r2 from r""",
        "el",
    ),
)
def mdl_ols_plain(spark, sf):
    panel, dummies = _small_panel(spark, sf)
    return _round_fit(regression.fit(panel, Spec("avg_div_whood", dummies)))


# Term -> label in coefficient tables.
TERM_LABELS = {
    f"year{PERIODS[1]}": "Year = 2006-2010 ACS",
    f"year{PERIODS[2]}": "Year = 2012-2016 ACS",
    "avg_div_nhood": "Average Neighborhood Diversity",
    "multi_theil_nhood": "Multiethnic Information Index ($H$)",
    "iso_nhood": "Isolation Index",
    "log_pop": "log(Metro Total Population)",
    "met_shr_nha": "Metro Share NL Asian",
    "met_shr_nhb": "Metro Share NL Black",
    "met_shr_h": "Metro Share Latinx",
    "met_shr_nho": "Metro Share NL Other",
    "met_shr_sub": "Metro Share Suburban",
    "met_shr_for_born": "Metro Share Foreign Born",
}


@query(
    "mdl_coef_table",
    with_ctes(
        f"""with {_DUMMY_PANEL}, ct as (select * from {_fe2_sql('pd', 'avg_div_whood', 'y10', 'y16', 'metro_id', '(1)', (TERM_LABELS[_YEAR_TERMS[0]], TERM_LABELS[_YEAR_TERMS[1]]))}
 union all select * from {_fe2_sql('pd', 'avg_div_whood', 'avg_div_nhood', 'multi_theil_nhood', 'metro_id', '(2)', (TERM_LABELS['avg_div_nhood'], TERM_LABELS['multi_theil_nhood']))})
 select *, case when abs(t) >= 3.290527e0 then '***' when abs(t) >= 2.575829e0 then '**' when abs(t) >= 1.959964e0 then '*' else '' end as stars from ct""",
        "el",
    ),
)
def mdl_coef_table(spark, sf):
    panel, dummies = _small_panel(spark, sf)
    fits = [
        regression.fit(panel, Spec("avg_div_whood", dummies, "metro_id", name="(1)")),
        regression.fit(panel, Spec("avg_div_whood", ["avg_div_nhood", "multi_theil_nhood"], "metro_id", name="(2)")),
    ]
    return _round_fit(regression.label_terms(fits, TERM_LABELS))


def _least_squares_sql(model_terms: str) -> str:
    """CTEs that solve models with any number of regressors, absorbed group means and errors by group.

    They need ``obs`` (model, row, g, w, i, v): values of variable ``i`` in long form, 0 being the outcome; and
    give ``solved`` (model, i, estimate, se and what the rest of the fit needs) for the regressors in
    ``model_terms`` (model, i). Gauss-Jordan elimination in place runs as a recursion over (row, column,
    value) rows, one pivot a step; a pivot that earlier regressors explain is passed over.
    """
    return f"""known as (select model, row from obs group by model, row having count(v) = count(*)),
 own as (select obs.* from obs join known using (model, row)),
 mid as (select *, v - sum(w * v) over (partition by model, g, i) / sum(w) over (partition by model, g, i) as x, v - avg(v) over (partition by model, i) as c from own),
 raw as (select model, i, sum(w * c * c) as spread from mid group by all),
 gram as (select a.model, a.i, b.i as j, sum(a.w * a.x * b.x) as v from mid a join mid b on a.model = b.model and a.row = b.row group by all),
 step0 as (select gram.*, case when gram.i = gram.j then greatest(1e-9 * gram.v, 1e-13 * spread) end as least from gram join raw using (model, i)),
 sweep as (
  select model, 1 as k, i, j, v, least, cast([] as integer[]) as done from step0
  union all
  select model, k + 1, i, j,
   case when not ok then v when i = k and j = k then 1 / d when i = k then v / d when j = k then -v / d else v - aik * akj / d end, least,
   case when ok then list_append(done, k) else done end
  from (select *, coalesce(d > pl, false) as ok from (
   select *, max(v) filter (j = k) over (partition by model, i) as aik, max(v) filter (i = k) over (partition by model, j) as akj,
    max(v) filter (i = k and j = k) over (partition by model) as d, max(least) filter (i = k and j = k) over (partition by model) as pl,
    max(i) over (partition by model) as top from sweep)) where k <= top),
 fin as (select * from sweep qualify k = max(k) over (partition by model)),
 beta as (select model, i, v as b from fin where j = 0 and list_contains(done, i)),
 bread as (select model, i, j, v from fin where list_contains(done, i) and list_contains(done, j)),
 shape as (select model, count(distinct row) as n, count(distinct g) as gg, count(distinct g) filter (w > 0) as gw from own group by 1),
 tss as (select model, v as yy from gram where i = 0 and j = 0),
 rss as (select model, v as rss from fin where i = 0 and j = 0),
 resid as (select mid.model, mid.row, max(mid.g) as g, max(mid.w) as w, sum(case when mid.i = 0 then mid.x else -b * mid.x end) as e
  from mid left join beta using (model, i) where mid.i = 0 or b is not null group by 1, 2),
 score as (select mid.model, mid.g, mid.i, sum(mid.w * mid.x * e) as u from mid join resid on mid.model = resid.model and mid.row = resid.row join beta on beta.model = mid.model and beta.i = mid.i group by all),
 meat as (select a.model, a.i, b.i as j, sum(a.u * b.u) as m from score a join score b on a.model = b.model and a.g = b.g group by all),
 half as (select b.model, b.i, m.j, sum(b.v * m.m) as h from bread b join meat m on b.model = m.model and b.j = m.i group by all),
 cov as (select h.model, h.i, b.j, sum(h.h * b.v) as v from half h join bread b on h.model = b.model and h.j = b.i group by all),
 solved as (select t.*, n, gg, b as estimate, cov.v as spread, yy, rss,
   (select count(*) from beta k where k.model = t.model) as used
  from {model_terms} t join shape using (model) join tss using (model) join rss using (model) left join beta using (model, i) left join cov on cov.model = t.model and cov.i = t.i and cov.j = t.i)"""


def _fits_sql(ctes: str, obs: str, terms: list[tuple[str, int, str, str]]) -> str:
    """The rows of :func:`regression.fit` for the models in ``terms``: (model, place, outcome, term)."""
    rows = ", ".join(f"('{m}', {i}, '{y}', '{t}')" for m, i, y, t in terms)
    return f"""with {ctes}, obs as ({obs}), terms(model, i, outcome, term) as (values {rows}), {_least_squares_sql('terms')},
 errs as (select *, sqrt((gg / (gg - 1e0)) * ((n - 1e0) / (n - used - 1e0)) * spread) as se from solved)
 select model, outcome, term, {r6('estimate')} as estimate, {r6('se')} as se, {r6('estimate / se')} as t, cast(n as bigint) as n, {r6('1 - rss / yy')} as r2 from errs"""


def _recursive(sql: str) -> str:
    return sql.replace("with ", "with recursive ", 1)


_PANEL_X = ["log_pop", "met_shr_nha", "met_shr_nhb", "met_shr_h", "met_shr_nho", "met_shr_sub", "met_shr_for_born"]


_STEPS = [
    [],
    ["avg_div_nhood"],
    ["avg_div_nhood", "multi_theil_nhood"],
    ["avg_div_nhood", "multi_theil_nhood", *_PANEL_X],
    ["avg_div_nhood", "iso_nhood"],
    ["avg_div_nhood", "iso_nhood", *_PANEL_X],
]


def _panel_fits_sql() -> str:
    obs, terms = [], []
    for m, x in enumerate(_STEPS, start=1):
        for i, c in enumerate(["avg_div_whood", "y10", "y16", *x]):
            obs.append(f"select '({m})' as model, metro_id || year as row, metro_id as g, 1e0 as w, {i} as i, cast({c} as double) as v from pd")
            if i:
                named = _YEAR_TERMS[i - 1] if i < 3 else c
                terms.append((f"({m})", i, "avg_div_whood", TERM_LABELS.get(named, named)))
    starred = "case when t is null then '' when abs(t) >= 3.290527e0 then '***' when abs(t) >= 2.575829e0 then '**' when abs(t) >= 1.959964e0 then '*' else '' end"
    fits = _fits_sql(_DUMMY_PANEL, " union all ".join(obs), terms)
    head, _, tail = fits.rpartition("\n select ")
    return _recursive(with_ctes(f"{head}, fits as (select {tail}) select *, {starred} as stars from fits", "el"))


@query("mdl_fe_ols_panel", _panel_fits_sql())
def mdl_fe_ols_panel(spark, sf):
    """The nested metro models up to all regressors, with H and with isolation."""
    panel, dummies = _small_panel(spark, sf)
    fits = [
        regression.fit(panel, Spec("avg_div_whood", [*dummies, *x], "metro_id", name=f"({i})"))
        for i, x in enumerate(_STEPS, start=1)
    ]
    return _round_fit(regression.label_terms(fits, TERM_LABELS))


_MD_X = ["chg_age_div", "chg_sex_div", "chg_lang_div", "chg_inc_div"]


_MD_OUTCOMES = ["chg_race_eth_div", "chg_nhb", "chg_nhw", "chg_h", "chg_nha"]


def _multidim_fits_sql() -> str:
    x = [*_MD_X, "trt_tot_pop_1k", "log_aland_mi2"]
    z = ", ".join(f"({c} - avg({c}) over ()) / stddev_samp({c}) over () as {c}" for c in ["chg_race_eth_div", *_MD_X])
    ctes = f"""{MULTIDIM_SQL}, ent as (select *, race_eth_div_am - race_eth_div_pm as chg_race_eth_div from {_entropy_cols('ty')} where year = '{PERIODS[2]}'),
 zs as (select * replace ({z}) from (select ent.*, md.* exclude (unit_id), (res_total_est + pow_total_est) / 1000e0 as trt_tot_pop_1k,
  ln(case when unit_id % 2 = 0 then 0.75e0 else 1e0 end) as log_aland_mi2 from md join ent using (unit_id) join customer on c_custkey = unit_id))"""
    obs = " union all ".join(
        f"select '{y}' as model, unit_id as row, metro_id as g, 1e0 as w, {i} as i, cast({c} as double) as v from zs"
        for y in _MD_OUTCOMES
        for i, c in enumerate([y, *x])
    )
    terms = [(y, i, y, c) for y in _MD_OUTCOMES for i, c in enumerate(x, start=1)]
    return _recursive(with_ctes(_fits_sql(ctes, obs, terms), "f10", "ty"))


@query("mdl_fe_ols_multidim", _multidim_fits_sql())
def mdl_fe_ols_multidim(spark, sf):
    """Changes in composition on standardized changes in other diversity, metro effects."""
    t = multidim_typed(spark, sf)
    t = t.withColumns(
        {
            "trt_tot_pop_1k": (F.col("res_total_est") + F.col("pow_total_est")) / 1000,
        }
    )
    land = fx.parcels(spark, sf).select(F.col("c_custkey").alias("unit_id"), F.ln(area(edges("rings"))).alias("log_aland_mi2"))
    t = joins.natural_join(t, land, "inner", ["unit_id"])
    outcomes = _MD_OUTCOMES
    t = settle(t.select("metro_id", *outcomes, *_MD_X, "trt_tot_pop_1k", "log_aland_mi2"))
    t = settle(reshape.zscores(t, ["chg_race_eth_div", *_MD_X]))
    x = [*_MD_X, "trt_tot_pop_1k", "log_aland_mi2"]
    return _round_fit(reshape.stack(*[regression.fit(t, Spec(y, x, "metro_id")) for y in outcomes]))


def _dummies_sql() -> str:
    """Margins from one dummy per cell of type and period, in all models at once."""
    ctes = f"""{_LONG}, cell as (select pm_cat, year, case when pm_cat = '{BASE_TYPE}' and year = '{BASE_PERIOD}' then 0
   else row_number() over (partition by pm_cat = '{BASE_TYPE}' and year = '{BASE_PERIOD}' order by pm_cat, year) end as i
  from (select distinct pm_cat, year from lo where pm_cat is not null and year is not null)),
 lw as (select m.model, lo.*, case m.model when 'fe' then 1e0 else cast(pow_total_est as double) end as w, cell.i as c
  from lo join (select unit_id, year, pow_total_est from el) using (unit_id, year) join cell using (pm_cat, year), (values ('fe'), ('wls')) m(model) where metro_id is not null and v is not null)"""
    obs = """select model || outcome as model, unit_id || year as row, metro_id as g, w, 0 as i, v from lw
  union all select lw.model || outcome, unit_id || lw.year, metro_id, w, cell.i, case when lw.c = cell.i then 1e0 else 0e0 end from lw, cell where cell.i > 0"""
    there = "(select distinct model || outcome as model, c as i from lw)"
    body = f"""with {ctes}, obs as ({obs}), {_least_squares_sql(there)},
 share as (select model, i, avg(m) as q from (select model, g, i, sum(w * v) / sum(w) as m from own group by all) group by all),
 aim as (select s.model, s.i, b.i as j, (case when s.i = b.i then 1e0 else 0e0 end) - q as a from solved s join beta b using (model) join share on share.model = s.model and share.i = b.i),
 wide as (select x.model, x.i, sum(x.a * cov.v * y.a) as v from aim x join cov on cov.model = x.model and cov.i = x.j join aim y on y.model = x.model and y.i = x.i and y.j = cov.j group by all),
 base as (select share.model, max(q) filter (share.i = 0) - sum(q * b) filter (share.i > 0 and b is not null) as m from share left join beta using (model, i) group by 1),
 mg as (select s.model, s.i, case when s.i = 0 or s.estimate is not null then base.m + coalesce(s.estimate, 0) end as pred,
   case when s.i = 0 or s.estimate is not null then sqrt((gg / (gg - 1e0)) * ((n - 1e0) / (n - (used + gg))) * wide.v) end as se
  from solved s join base using (model) join wide on wide.model = s.model and wide.i = s.i)
 select d.model, outcome, d.pm_cat, d.year, {r6('pred')} as pred, {r6('se')} as se, {r6('pred - 1.959964e0 * se')} as lower, {r6('pred + 1.959964e0 * se')} as upper
 from mg join (select distinct model, outcome, pm_cat, year, c from lw) d on mg.model = d.model || d.outcome and mg.i = d.c"""
    return _recursive(with_ctes(body, "el"))


@query("mdl_ols_metro_dummies", _dummies_sql())
def mdl_ols_metro_dummies(spark, sf):
    """Margins of type by period with metro effects, unweighted and weighted by workers."""
    u = settle(modelled(spark, sf).select("metro_id", "pm_cat", "year", "pow_total_est", *OUTCOMES))
    out = []
    for weight, model in [(None, "fe"), ("pow_total_est", "wls")]:
        m = regression.category_margins(
            u, OUTCOMES, ["pm_cat", "year"], [BASE_TYPE, BASE_PERIOD], "metro_id", weight
        )
        out.append(m.withColumn("model", F.lit(model)))
    return reshape.across(reshape.stack(*out), _MARGIN, rounded)


_MARGIN = ["pred", "se", "lower", "upper"]
# Closed form for two cells: x marks the second one. Per outcome: b from within-group moments; the
# margins are the mean group level and that plus b; scores u per group; q the mean share of x in a group.
_TWO_SQL = f"""with {_LONG}, d as (select outcome, metro_id as g, case when pm_cat = '{BASE_TYPE}' then 0e0 else 1e0 end as x, v from lo),
 gr as (select outcome, g, count(*) as n, sum(x) as sx, avg(x) as mx, avg(v) as mv, sum(x * v) - sum(x) * sum(v) / count(*) as xy, sum(x * x) - sum(x) * sum(x) / count(*) as xx from d group by all),
 fit as (select outcome, sum(xy) / sum(xx) as b, sum(xx) as sxx, avg(mx) as q, sum(n) as nobs, count(*) as m from gr group by outcome),
 sc as (select outcome, sum(u * u) as meat, avg(level) as level from (select gr.outcome, mv - b * mx as level, xy - b * xx as u from gr join fit using (outcome)) group by outcome),
 mg as (select outcome, c.cell, level + c.x * b as pred, sqrt((m / (m - 1e0)) * ((nobs - 1e0) / (nobs - (m + 1))) * meat) / sxx * abs(c.x - q) as se
  from fit join sc using (outcome), (values ('base', 0e0), ('other', 1e0)) c(cell, x))
 select outcome, cell, {r6('pred')} as pred, {r6('se')} as se, {r6('pred - 1.959964e0 * se')} as lower, {r6('pred + 1.959964e0 * se')} as upper from mg"""


@query("mdl_fe_margins_two", with_ctes(_TWO_SQL, "el"))
def mdl_fe_margins_two(spark, sf):
    """Margins of the base type and of all others with metro effects and errors by metro."""
    cell = F.when(F.col("pm_cat") == BASE_TYPE, "base").otherwise("other")
    u = modelled(spark, sf).select("metro_id", cell.alias("cell"), *OUTCOMES)
    m = regression.category_margins(u, OUTCOMES, ["cell"], ["base"], "metro_id")
    return reshape.across(m, _MARGIN, rounded)
