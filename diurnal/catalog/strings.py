"""Queries: text functions and label parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from . import fixtures as fx
from .fixtures import with_ctes
from .registry import query

_ENDINGS = text.COUNTY_ENDINGS
_PAD = "case when length({0}) >= {1} then {0} else lpad({0}, {1}, '0') end"


def _tail(x: str, sep: str) -> str:
    """SQL: the text after the first separator, '' when there is none."""
    return f"case when strpos({x}, '{sep}') = 0 then '' else substr({x}, strpos({x}, '{sep}') + {len(sep)}) end"


_PARSED = f"""
parsed as (select unit_id, trt_name, {_PAD.format('pre', 4)} || {_PAD.format('post', 2)} as tractfp,
  trim(lsad) as countylsad, trim(regexp_replace(trim(lsad), '{_ENDINGS}', '', 'g')) as county, state
 from (select *, split_part(code, '.', 1) as pre, {_tail('code', '.')} as post, split_part(place, ', ', 1) as lsad, {_tail('place', ', ')} as state
  from (select *, replace(trt_name, 'Census Tract ', '') as code from
   (select unit_id, split_part(trt_string, ',', 1) as trt_name, {_tail('trt_string', ', ')} as place from f5))))
"""


@query(
    "str_split_fixed",
    with_ctes(
        f"select unit_id, split_part(trt_string, ', ', 1) as first, split_part(trt_string, ', ', 2) as second, {_tail(_tail('trt_string', ', '), ', ')} as rest, '' as missing from f5",
        "f5",
    ),
)
def str_split_fixed(spark, sf):
    piece = lambda k, n=3: text.split_piece("trt_string", ", ", n, k)
    return fx.labels(spark, sf).select(
        "unit_id",
        piece(1).alias("first"),
        piece(2).alias("second"),
        piece(3).alias("rest"),
        text.split_piece("trt_string", "#", 2, 2).alias("missing"),
    )


@query(
    "str_remove_suffix",
    with_ctes(f"select unit_id, regexp_replace(trt_string, '{_ENDINGS}', '', 'g') as bare from f5", "f5"),
)
def str_remove_suffix(spark, sf):
    return fx.labels(spark, sf).select("unit_id", text.remove_all("trt_string", _ENDINGS).alias("bare"))


@query(
    "str_pad_left",
    "select c_custkey as unit_id, "
    + _PAD.format("cast(c_custkey as varchar)", 4)
    + " as four, "
    + _PAD.format("cast(c_custkey % 13 as varchar)", 2)
    + " as two, "
    + _PAD.format("cast(c_custkey + 99000 as varchar)", 4)
    + " as kept from customer",
)
def str_pad_left(spark, sf):
    k = F.col("c_custkey")
    return fx.table(spark, sf, "customer").select(
        k.alias("unit_id"),
        text.pad_left(k.cast("string"), 4).alias("four"),
        text.pad_left((k % 13).cast("string"), 2).alias("two"),
        text.pad_left((k + 99000).cast("string"), 4).alias("kept"),
    )


@query(
    "str_basic",
    with_ctes(
        """select unit_id, trim(concat('  ', trt_string, ' ')) as trimmed, substr(trt_string, 1, 6) as head, lower(trt_string) as lowered,
 contains(trt_string, 'Tract 9') as hit, regexp_replace(trt_string, '[ ,]', '_', 'g') as replaced, concat(cast(unit_id as varchar), '-', substr(trt_string, 8, 5)) as pasted from f5""",
        "f5",
    ),
)
def str_basic(spark, sf):
    s = F.col("trt_string")
    return fx.labels(spark, sf).select(
        "unit_id",
        F.trim(F.concat(F.lit("  "), s, F.lit(" "))).alias("trimmed"),
        F.substring(s, 1, 6).alias("head"),
        F.lower(s).alias("lowered"),
        s.rlike("Tract 9").alias("hit"),
        F.regexp_replace(s, "[ ,]", "_").alias("replaced"),
        F.concat(F.col("unit_id").cast("string"), F.lit("-"), F.substring(s, 8, 5)).alias("pasted"),
    )


_NUMBER = "try_cast(replace(regexp_extract({0}, '-?[0-9][0-9,]*\\.?[0-9]*', 0), ',', '') as double)"


@query(
    "str_parse_number",
    with_ctes(
        f"select unit_id, type, earnings_str, value, {_NUMBER.format('value')} as number, {_NUMBER.format('earnings_str')} as first_in_label from f9",
        "f9",
    ),
)
def str_parse_number(spark, sf):
    return fx.earnings(spark, sf).withColumns(
        {"number": text.parse_number("value"), "first_in_label": text.parse_number("earnings_str")}
    )


@query("lbl_parse_tract", with_ctes(f"with {_PARSED} select * from parsed where state not in ('Puerto Rico', '') and trt_name <> 'Tract 999999'", "f5"))
def lbl_parse_tract(spark, sf):
    parsed = fx.labels(spark, sf).select("unit_id", text.parse_tract_label("trt_string").alias("p"))
    return parsed.select("unit_id", "p.*").filter(text.usable_tract("state", "trt_name"))


@query(
    "lbl_build_geoid",
    with_ctes(
        f"""with {_PARSED} select p.unit_id, lpad(cast(c_nationkey as varchar), 2, '0') || lpad(cast(c_custkey % 1000 as varchar), 3, '0') || tractfp as geoid,
 'G' || substr(lpad(cast(c_nationkey as varchar), 2, '0') || '0' || tractfp, 1, 2) || substr(tractfp, 1, 4) as legacy_id from parsed p join customer on p.unit_id = c_custkey""",
        "f5",
    ),
)
def lbl_build_geoid(spark, sf):
    c = fx.table(spark, sf, "customer")
    parsed = fx.labels(spark, sf).select("unit_id", text.parse_tract_label("trt_string")["tractfp"].alias("tractfp"))
    state = text.pad_left(F.col("c_nationkey").cast("string"), 2)
    county = text.pad_left((F.col("c_custkey") % 1000).cast("string"), 3)
    legacy = F.concat(state, F.lit("0"), "tractfp")
    return parsed.join(c, parsed.unit_id == c.c_custkey).select(
        "unit_id",
        F.concat(state, county, "tractfp").alias("geoid"),
        F.concat(F.lit("G"), F.substring(legacy, 1, 2), F.substring("tractfp", 1, 4)).alias("legacy_id"),
    )


BRACKET_SQL = f"""
br as (select unit_id, type, earnings_str, {_NUMBER.format('value')} as value,
  case when lower_ = 1 then 0e0 else lower_ end as lower_bound, upper_ as upper_bound,
  case when upper_ is null then null when upper_ < 25000 then '0_24999' when upper_ < 50000 then '25000_49999' when upper_ < 75000 then '50000_74999' else '75000_or_more' end as band
 from (select *, case when regexp_matches(split_part(earnings_str, ' to ', 1), 'loss|No earnings') then 0e0 else {_NUMBER.format("split_part(earnings_str, ' to ', 1)")} end as lower_,
   case when contains(earnings_str, 'No earnings') then 4999e0 when contains(earnings_str, 'or more') then 'Infinity'::double when contains(earnings_str, 'or loss') then 4999e0
    else {_NUMBER.format(_tail('earnings_str', ' to '))} end as upper_
  from f9 where not contains(earnings_str, 'Total')))
"""


@query(
    "lbl_parse_bracket",
    with_ctes(
        f"with {BRACKET_SQL} select unit_id, type, band, lower_bound, case when isinf(upper_bound) then -1e0 else upper_bound end as upper_bound, sum(value) as estimate from br group by 1, 2, 3, 4, 5",
        "f9",
    ),
)
def lbl_parse_bracket(spark, sf):
    rows = fx.earnings(spark, sf).filter(~F.col("earnings_str").contains("Total"))
    parsed = rows.withColumn("b", text.earning_bounds("earnings_str"))
    return parsed.groupBy(
        "unit_id",
        "type",
        F.col("b.band").alias("band"),
        F.col("b.lower").alias("lower_bound"),
        F.when(F.col("b.upper") == float("inf"), -1.0).otherwise(F.col("b.upper")).alias("upper_bound"),
    ).agg(F.sum(text.parse_number("value")).alias("estimate"))


@query(
    "lbl_metro_slug",
    "select n_nationkey as metro_id, lower(regexp_replace(replace(regexp_split_to_array(concat(n_name, '-', r_name, ', X.Y/Z'), '-|,')[1], '.', ''), ' |/', '_', 'g')) as slug from nation join region on n_regionkey = r_regionkey",
)
def lbl_metro_slug(spark, sf):
    n, r = fx.table(spark, sf, "nation"), fx.table(spark, sf, "region")
    name = F.concat("n_name", F.lit("-"), "r_name", F.lit(", X.Y/Z"))
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").alias("metro_id"), text.metro_slug(name).alias("slug")
    )
