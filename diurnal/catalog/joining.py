"""Queries: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, reshape
from ..plans.analyses import AGE_BANDS, LANGUAGE_BANDS, POVERTY_BANDS, band_of
from . import fixtures as fx
from .fixtures import with_ctes
from .registry import query


def _keyed(spark, sf):
    """Areas whose metro id is missing for every 11th area."""
    c = fx.table(spark, sf, "customer")
    key = F.when(F.col("c_custkey") % 11 != 0, F.col("c_nationkey"))
    return c.select(F.col("c_custkey").alias("unit_id"), key.alias("metro_id"), "c_acctbal")


def _metros(spark, sf):
    """Metro names, one entry standing for the missing id and some ids matching nothing."""
    n, k = fx.table(spark, sf, "nation"), F.col("n_nationkey")
    key = F.when(k == 7, None).when(k >= 20, k + 100).otherwise(k)
    return n.select(key.alias("metro_id"), F.col("n_name").alias("metro_name"))


_KEYED = """a as (select c_custkey as unit_id, case when c_custkey % 11 <> 0 then c_nationkey end as metro_id, c_acctbal from customer),
b as (select case when n_nationkey = 7 then null when n_nationkey >= 20 then n_nationkey + 100 else n_nationkey end as metro_id, n_name as metro_name from nation)
"""


@query(
    "jn_natural_left",
    f"with {_KEYED} select a.unit_id, a.metro_id, a.c_acctbal, b.metro_name from a left join b on a.metro_id is not distinct from b.metro_id",
)


def jn_natural_left(spark, sf):
    return joins.natural_join(_keyed(spark, sf), _metros(spark, sf), "left")


@query(
    "jn_natural_inner",
    f"with {_KEYED} select a.unit_id, a.metro_id, a.c_acctbal, b.metro_name from a join b on a.metro_id is not distinct from b.metro_id",
)


def jn_natural_inner(spark, sf):
    return joins.natural_join(_keyed(spark, sf), _metros(spark, sf), "inner")


@query(
    "jn_renamed_key",
    with_ctes(
        "select unit_id, year, res_total_est, to_id, weight from f2 left join f4 on unit_id = from_id where year = '2000'",
        "f2",
        "f4",
    ),
)


def jn_renamed_key(spark, sf):
    u = fx.units(spark, sf).filter(F.col("year") == "2000").select("unit_id", "year", "res_total_est")
    return joins.renamed_key_join(u, fx.crosswalk(spark, sf), {"unit_id": "from_id"}, "left")


def _dimensions():
    """Names, levels and prefix of each dimension: age, sex, language, poverty."""
    return [
        (band_of("age", AGE_BANDS), list(AGE_BANDS), "tot_age_"),
        (F.lower("sex"), ["male", "female"], "tot_sex_"),
        (band_of("lang", LANGUAGE_BANDS, "oth"), ["eng", "span", "oth"], "tot_lang_"),
        (band_of("pov_status", POVERTY_BANDS), list(POVERTY_BANDS), "tot_"),
    ]


def all_dimensions(spark, sf):
    return reshape.widen_sums(fx.dimensions(spark, sf), ["unit_id", "type"], _dimensions(), "value")


def _wide_sql(band: str, levels: list[str], prefix: str) -> str:
    cells = ", ".join(f"sum(case when band = '{v}' then value end) as \"{prefix}{v}\"" for v in levels)
    return f"select unit_id, type, {cells} from (select unit_id, type, value, {band} as band from f10) group by 1, 2"


def _band_sql(column: str, bands: dict[str, list[str]], other: str = "null") -> str:
    whens = " ".join(
        f"when {column} in ({', '.join(repr(v) for v in labels)}) then '{name}'" for name, labels in bands.items()
    )
    return f"case {whens} else {other} end"


DIMENSION_SQL = f"""
d_age as ({_wide_sql(_band_sql('age', AGE_BANDS), list(AGE_BANDS), 'tot_age_')}),
d_sex as ({_wide_sql('lower(sex)', ['male', 'female'], 'tot_sex_')}),
d_lang as ({_wide_sql(_band_sql('lang', LANGUAGE_BANDS, "'oth'"), ['eng', 'span', 'oth'], 'tot_lang_')}),
d_pov as ({_wide_sql(_band_sql('pov_status', POVERTY_BANDS), list(POVERTY_BANDS), 'tot_')}),
dims as (select * from d_age join d_sex using (unit_id, type) join d_lang using (unit_id, type) join d_pov using (unit_id, type))
"""


@query("jn_nway_wide", with_ctes(f"with {DIMENSION_SQL} select * from dims", "f10"))
def jn_nway_wide(spark, sf):
    return all_dimensions(spark, sf)


@query("agg_collapse_categories", with_ctes(f"with {DIMENSION_SQL} select * from d_age", "f10"))
def agg_collapse_categories(spark, sf):
    names, levels, prefix = _dimensions()[0]
    d = fx.dimensions(spark, sf).withColumn("band", names)
    return reshape.widen_sum(d, ["unit_id", "type"], "band", levels, "value", prefix)


@query(
    "jn_right_grid",
    with_ctes(
        """select year, pm_cat, am_cat, coalesce(n, 0) as n from (select * from (select distinct year from ty), (select distinct pm_cat from ty), (select distinct am_cat from ty)) g
 left join (select year, pm_cat, am_cat, cast(count(*) as bigint) as n from ty group by 1, 2, 3) c using (year, pm_cat, am_cat)""",
        "ty",
    ),
)


def jn_right_grid(spark, sf):
    t = fx.typed(spark, sf)
    keys = ["year", "pm_cat", "am_cat"]
    counts = t.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return joins.complete_grid(counts, joins.category_grid(t, keys), {"n": 0})


@query(
    "jn_cross_grid",
    with_ctes(
        "select * from (select distinct year from f1), (select distinct type from f1), (select distinct grp from f1), (select distinct state from f1)",
        "f1",
    ),
)


def jn_cross_grid(spark, sf):
    return joins.category_grid(fx.unit_counts(spark, sf), ["year", "type", "grp", "state"])


@query(
    "jn_semi",
    with_ctes("select unit_id, metro_id, x, y from f6 where unit_id in (select unit_id from ty where pm_cat = 'Multiethnic')", "f6", "ty"),
)


def jn_semi(spark, sf):
    mixed = fx.typed(spark, sf).filter(F.col("pm_cat") == "Multiethnic")
    return joins.natural_join(fx.points(spark, sf), mixed.select("unit_id").distinct(), "left_semi")


@query("jn_in_lists", with_ctes("select unit_id, metro_id, year, pm_cat, am_cat from el", "el"))
def jn_in_lists(spark, sf):
    return fx.eligible(spark, sf).select("unit_id", "metro_id", "year", "pm_cat", "am_cat")


@query(
    "jn_anti_qa",
    with_ctes(
        "select metro_id, year, cast(count(*) as bigint) as n from f2 where unit_id not in (select unit_id from f2 where year = '2012-2016 ACS' and res_total_est > 0) group by 1, 2",
        "f2",
    ),
)


def jn_anti_qa(spark, sf):
    u = fx.units(spark, sf)
    last = u.filter((F.col("year") == "2012-2016 ACS") & (F.col("res_total_est") > 0))
    return joins.unmatched_counts(u, last, "unit_id", ["metro_id", "year"])


def _home(spark, sf):
    return fx.places(spark, sf).select(F.col("unit_id").alias("id"), "metro_id", "state")


@query(
    "jn_origin_dest",
    with_ctes(
        """select res_id, pow_id, h.metro_id as res_metro_id, h.state as res_state, w.metro_id as pow_metro_id, w.state as pow_state, total_est from f8
 left join (select c_custkey as id, c_nationkey as metro_id, r_name as state from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey) h on res_id = h.id
 left join (select c_custkey as id, c_nationkey as metro_id, r_name as state from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey) w on pow_id = w.id""",
        "f8",
    ),
)


def jn_origin_dest(spark, sf):
    f = fx.flows(spark, sf).select("res_id", "pow_id", "total_est")
    return joins.join_both_ends(f, _home(spark, sf), "id")
