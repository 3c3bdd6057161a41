"""Test tables seen as neighborhood data, as DataFrames and as SQL.

Customers stand for areas, nations for metros, regions for states, order dates for periods,
line status for night (F) and day (O), order priorities for groups of workers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.composition import GROUPS, PERIODS, SIDES, type7
from ..functions.shapes import ring
from ..operators.joins import natural_join
from ..operators.segregation import add_composition, eligible_units
from ..session import settle

ELIGIBILITY = {
    "res_total_est": 8000.0,
    "res_nhb_est": 1500.0,
    "res_nhw_est": 1500.0,
    "res_h_est": 1500.0,
    "res_nha_est": 1500.0,
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _period(date: Column) -> Column:
    return (
        F.when(date < F.lit("1997-01-01").cast("timestamp"), PERIODS[0])
        .when(date < F.lit("1999-01-01").cast("timestamp"), PERIODS[1])
        .otherwise(PERIODS[2])
    )


def _side(status: Column) -> Column:
    return F.when(status == "F", SIDES["pm"]).otherwise(SIDES["am"])


def places(spark: SparkSession, sf: str) -> DataFrame:
    """unit_id, metro_id, metro_name, state."""
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    nations = n.join(r, n.n_regionkey == r.r_regionkey)
    return c.join(nations, c.c_nationkey == nations.n_nationkey).select(
        F.col("c_custkey").alias("unit_id"),
        F.col("c_nationkey").alias("metro_id"),
        F.col("n_name").alias("metro_name"),
        F.col("r_name").alias("state"),
    )


def unit_counts(spark: SparkSession, sf: str) -> DataFrame:
    """f1: counts per area, period, side of the day and group.

    Line items fold to at most two rows per order, and orders to at most thirty rows per
    area, before the next join sees them.
    """
    lines = (
        table(spark, sf, "lineitem")
        .groupBy("l_orderkey", _side(F.col("l_linestatus")).alias("type"))
        .agg(F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("lines"))
    )
    o = table(spark, sf, "orders")
    group = F.substring("o_orderpriority", 1, 1)
    grp = F.when(group == "1", "nhw").when(group == "2", "nhb").when(group == "3", "h")
    counts = (
        lines.join(o, lines.l_orderkey == o.o_orderkey)
        .groupBy(
            F.col("o_custkey").alias("unit_id"),
            _period(F.col("o_orderdate")).alias("year"),
            "type",
            grp.when(group == "4", "nha").otherwise("nho").alias("grp"),
        )
        .agg(F.sum("qty").alias("est"), F.sum("lines").alias("n"))
    )
    return natural_join(counts, places(spark, sf), "inner", ["unit_id"]).select(
        "unit_id", "metro_id", "metro_name", "state", "year", "type", "grp", "est", "n"
    )


def units(spark: SparkSession, sf: str) -> DataFrame:
    """f2: one wide row per area and period."""
    ids = ["unit_id", "metro_id", "metro_name", "state", "year"]

    def cell(side: str, grp: str | None) -> Column:
        inside = F.col("type") == side
        if grp:
            inside = inside & (F.col("grp") == grp)
        name = f"{side}_{grp or 'total'}_est"
        return F.coalesce(F.sum(F.when(inside, F.col("est"))), F.lit(0.0)).alias(name)

    cells = [cell(s, g) for s in SIDES.values() for g in (None, *GROUPS)]
    wide = unit_counts(spark, sf).groupBy(*ids).agg(*cells)
    return wide.withColumn("prin_city", F.col("unit_id") % 3 == 0)


def composed(spark: SparkSession, sf: str) -> DataFrame:
    """sh: f2 with shares and changes."""
    return add_composition(units(spark, sf))


def typed(spark: SparkSession, sf: str) -> DataFrame:
    """ty: areas with people by day and by night, with types."""
    peopled = composed(spark, sf).filter((F.col("res_total_est") > 0) & (F.col("pow_total_est") > 0))
    return peopled.withColumns({"pm_cat": type7("pm"), "am_cat": type7("am")})


def eligible(spark: SparkSession, sf: str) -> DataFrame:
    """el: typed areas of metros with enough people of each group in the first period."""
    u = eligible_units(settle(composed(spark, sf)), "metro_id", "unit_id", ELIGIBILITY)
    return u.withColumns({"pm_cat": type7("pm"), "am_cat": type7("am")})


def crosswalk(spark: SparkSession, sf: str) -> DataFrame:
    """f4: area to area with weights .75 and .25, some targets missing."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("from_id"))
    parts = F.array(
        F.struct(F.col("from_id").alias("to_id"), F.lit(0.75).alias("weight")),
        F.struct(
            F.when(F.col("from_id") % 50 != 0, F.col("from_id") - 1).alias("to_id"),
            F.lit(0.25).alias("weight"),
        ),
    )
    return c.select("from_id", F.inline(parts))


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """f5: messy area labels."""
    p = places(spark, sf)
    k = F.col("unit_id")
    number = F.concat(
        F.lit("Census Tract "),
        (1 + k % 9990).cast("string"),
        F.when(k % 3 == 0, F.concat(F.lit("."), F.lpad((1 + k % 20).cast("string"), 2, "0"))).otherwise(""),
    )
    ending = F.element_at(
        F.array(*[F.lit(e) for e in (" County", " Parish", " Borough", " city", " Municipality")]),
        (k % 5 + 1).cast("int"),
    )
    return p.select(
        "unit_id",
        F.concat(
            F.when(k % 97 == 0, F.lit("Tract 999999")).otherwise(number),
            F.lit(", "),
            "metro_name",
            ending,
            F.lit(", "),
            "state",
        ).alias("trt_string"),
    )


def points(spark: SparkSession, sf: str) -> DataFrame:
    """f6: a point per area in a 5 x 5 plane."""
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("unit_id"),
        F.col("c_nationkey").alias("metro_id"),
        (((k * 37) % 1000 + 0.5) / 200).alias("x"),
        (((k * 91) % 1000 + 0.5) / 200).alias("y"),
    )


def scattered(spark: SparkSession, sf: str) -> DataFrame:
    """f6s: the same points moved off the lattice, each by its own part of a step."""
    k = F.col("unit_id").cast("bigint")
    own = lambda a, b: (k * k * a % b).cast("double") / b / 200
    return points(spark, sf).withColumns({"x": F.col("x") + own(7919, 1009), "y": F.col("y") + own(104729, 997)})


def persons(spark: SparkSession, sf: str) -> DataFrame:
    """f7: person microdata."""
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    race = F.when(seg == "AUTOMOBILE", 1).when(seg == "BUILDING", 2).when(seg == "FURNITURE", 5)
    return table(spark, sf, "customer").select(
        k.alias("serial"),
        F.col("c_nationkey").alias("met_id"),
        F.when(k % 3 == 0, 2000).when(k % 3 == 1, 2010).otherwise(2016).alias("yr"),
        race.when(seg == "HOUSEHOLD", 1).otherwise(8).alias("race"),
        F.when(seg == "HOUSEHOLD", 1).otherwise(0).alias("hispan"),
        (1 + k % 7).alias("perwt"),
        (1 + k % 5).alias("hhwt"),
        F.col("c_acctbal").alias("hhincome"),
        (k % 200).alias("bpl"),
        (k % 81).alias("occscore"),
        (k % 97).alias("sei"),
    )


def flows(spark: SparkSession, sf: str) -> DataFrame:
    """f8: home to work flows."""
    o = table(spark, sf, "orders")
    first = F.col("o_orderpriority") == "1-URGENT"
    qty = F.col("l_quantity")
    part = lambda c: F.coalesce(F.sum(F.when(c, qty)), F.lit(0.0))
    return (
        table(spark, sf, "lineitem")
        .join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_custkey").alias("res_id"), F.col("l_suppkey").alias("pow_id"))
        .agg(F.sum(qty).alias("total_est"), part(first).alias("nhw_est"), part(~first).alias("oth_est"))
    )


def earnings(spark: SparkSession, sf: str) -> DataFrame:
    """f9: earnings labels with counts written with thousands marks."""
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    label = F.when(k % 11 == 0, "Total").when(k % 13 == 0, "No earnings")
    # Earnings labels of the fixture by exclusive upper price.
    for top, text in [
        (60000, "$1 to $9,999 or loss"),
        (140000, "$10,000 to $14,999"),
        (200000, "$15,000 to $24,999"),
        (280000, "$25,000 to $34,999"),
        (340000, "$35,000 to $49,999"),
        (420000, "$50,000 to $74,999"),
    ]:
        label = label.when(price < top, text)
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("unit_id"),
        F.when(F.col("o_orderstatus") == "O", "pow").otherwise("res").alias("type"),
        label.otherwise("$75,000 or more").alias("earnings_str"),
        F.concat(
            (1 + k % 3).cast("string"), F.lit(","), F.lpad((k % 1000).cast("string"), 3, "0")
        ).alias("value"),
    )


def dimensions(spark: SparkSession, sf: str) -> DataFrame:
    """f10: counts by age, sex, language and poverty."""
    # Age labels of the fixture by line number.
    ages = [
        "16 and 17 years",
        "18 to 20 years",
        "25 to 44 years",
        "45 to 59 years",
        "60 to 64 years",
        "65 to 74 years",
        "75 years and over",
    ]
    line, flag, part = F.col("l_linenumber"), F.col("l_returnflag"), F.col("l_partkey") % 3
    age = F.element_at(F.array(*[F.lit(a) for a in ages]), F.least(line, F.lit(7)))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return (
        table(spark, sf, "lineitem")
        .join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("o_custkey").alias("unit_id"),
            _side(F.col("l_linestatus")).alias("type"),
            age.alias("age"),
            F.when(F.col("l_suppkey") % 2 == 0, "Male").otherwise("Female").alias("sex"),
            F.when(flag == "A", "Speak only English")
            .when(flag == "N", "Spanish")
            .otherwise("Other language")
            .alias("lang"),
            F.when(part == 0, "Below 100 percent of the poverty level")
            .when(part == 1, "100 to 149 percent of the poverty level")
            .otherwise("At or above 150 percent of the poverty level")
            .alias("pov_status"),
            F.col("l_quantity").alias("value"),
        )
    )


def metro_squares(spark: SparkSession, sf: str) -> DataFrame:
    """Metro k as the unit square with lower-left corner (k % 5, k / 5)."""
    n = table(spark, sf, "nation")
    x = (F.col("n_nationkey") % 5).cast("double")
    y = F.floor(F.col("n_nationkey") / 5).cast("double")
    return n.select(
        F.col("n_nationkey").alias("metro_key"),
        F.col("n_name").alias("metro_label"),
        F.array(ring((x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1))).alias("rings"),
    )


def place_diamonds(spark: SparkSession, sf: str) -> DataFrame:
    """Two parts per metro square: a diamond with a diamond hole in the middle, and a small square."""
    n = table(spark, sf, "nation")
    x = (F.col("n_nationkey") % 5).cast("double") + 0.5
    y = F.floor(F.col("n_nationkey") / 5).cast("double") + 0.5
    diamond = lambda h: ring((x - h, y), (x, y - h), (x + h, y), (x, y + h))
    a, b = 0.401, 0.481
    return n.select(
        F.concat(F.lit("Place "), F.col("n_name")).alias("place_name"),
        F.when(F.col("n_nationkey") % 2 == 0, "Y").otherwise("N").alias("prin_flag"),
        F.array(
            diamond(0.3525), F.reverse(diamond(0.1525)), ring((x + a, y + a), (x + b, y + a), (x + b, y + b), (x + a, y + b))
        ).alias("rings"),
    )


def parcels(spark: SparkSession, sf: str) -> DataFrame:
    """Area k as the unit square with lower-left corner (k % 100, k / 100); even ones have a hole."""
    c = table(spark, sf, "customer")
    x = (F.col("c_custkey") % 100).cast("double")
    y = F.floor(F.col("c_custkey") / 100).cast("double")
    outer = ring((x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1))
    hole = ring((x + 0.25, y + 0.25), (x + 0.25, y + 0.75), (x + 0.75, y + 0.75), (x + 0.75, y + 0.25))
    rings = F.when(F.col("c_custkey") % 2 == 0, F.array(outer, hole)).otherwise(F.array(outer))
    return c.select("c_custkey", "c_nationkey", F.col("c_name").alias("label"), rings.alias("rings"))


def unit_triangles(spark: SparkSession, sf: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return points(spark, sf).select(
        "unit_id", "metro_id", F.array(ring((x, y), (x + 0.03, y), (x, y + 0.03))).alias("rings")
    )


# --------------------------------------------------------------------------------------
# SQL counterparts
# --------------------------------------------------------------------------------------


def r6(expr: str) -> str:
    """Rounded double without a negative zero."""
    return f"(round(cast({expr} as double), 6) + 0e0)"


def _share_sql() -> str:
    out = []
    for side, p in SIDES.items():
        whole = f"nullif({p}_total_est, 0)"
        out += [f"{p}_{g}_est / {whole} as trt_shr_{g}_{side}" for g in GROUPS[:4]]
        named = " + ".join(f"{p}_{g}_est" for g in GROUPS[:4])
        out.append(f"({p}_total_est - ({named})) / {whole} as trt_shr_nho_{side}")
    return ", ".join(out)


def _type7_sql(side: str) -> str:
    s = lambda g: f"trt_shr_{g}_{side}"
    mixed = " or ".join(f"({s(g)} < 0.75e0 and {s(g)} >= 0.5e0)" for g in ("nhb", "h", "nha"))
    return (
        f"case when {s('nhw')} >= 0.75e0 then 'Predominantly White' "
        f"when {s('nhb')} >= 0.75e0 then 'Predominantly Black' "
        f"when {s('nha')} >= 0.75e0 then 'Predominantly Asian' "
        f"when {s('h')} >= 0.75e0 then 'Predominantly Latinx' "
        f"when {s('nhw')} < 0.75e0 and {s('nhw')} >= 0.5e0 then 'White-Mixed' "
        f"when {mixed} then 'Non-White-Mixed' else 'Multiethnic' end as {side}_cat"
    )


_F2_CELLS = ", ".join(
    f"coalesce(sum(case when type = '{p}'{cond} then est end), 0) as {p}_{name}_est"
    for p in SIDES.values()
    for name, cond in [("total", ""), *[(g, f" and grp = '{g}'") for g in GROUPS]]
)

CTES: dict[str, tuple[list[str], str]] = {
    "f1": (
        [],
        """select o.o_custkey as unit_id, c.c_nationkey as metro_id, n.n_name as metro_name, r.r_name as state,
  case when o.o_orderdate < timestamp '1997-01-01' then '2000' when o.o_orderdate < timestamp '1999-01-01' then '2006-2010 ACS' else '2012-2016 ACS' end as year,
  case l.l_linestatus when 'F' then 'res' else 'pow' end as type,
  case substr(o.o_orderpriority,1,1) when '1' then 'nhw' when '2' then 'nhb' when '3' then 'h' when '4' then 'nha' else 'nho' end as grp,
  sum(l.l_quantity) as est, cast(count(*) as bigint) as n
from lineitem l join orders o on l.l_orderkey=o.o_orderkey join customer c on o.o_custkey=c.c_custkey
join nation n on c.c_nationkey=n.n_nationkey join region r on n.n_regionkey=r.r_regionkey
group by 1,2,3,4,5,6,7""",
    ),
    "f2": (
        ["f1"],
        f"select unit_id, metro_id, metro_name, state, year, (unit_id % 3 = 0) as prin_city, {_F2_CELLS} from f1 group by 1,2,3,4,5,6",
    ),
    "sh0": (["f2"], f"select *, {_share_sql()} from f2"),
    "sh": (
        ["sh0"],
        "select *, "
        + ", ".join(f"trt_shr_{g}_am - trt_shr_{g}_pm as chg_{g}" for g in GROUPS)
        + " from sh0",
    ),
    "ty": (
        ["sh"],
        f"select *, {_type7_sql('pm')}, {_type7_sql('am')} from sh where res_total_est > 0 and pow_total_est > 0",
    ),
    "okm": (
        ["ty"],
        "select metro_id from ty where year = '2000' group by metro_id having "
        + " and ".join(f"coalesce(sum({c}), 0) >= {v:g}" for c, v in ELIGIBILITY.items()),
    ),
    "el": (["ty", "okm"], "select * from ty where metro_id in (select metro_id from okm)"),
    "f4": (
        [],
        """select c_custkey as from_id, c_custkey as to_id, 0.75e0 as weight from customer
union all select c_custkey, case when c_custkey % 50 = 0 then null else c_custkey - 1 end, 0.25e0 from customer""",
    ),
    "f5": (
        [],
        """select c.c_custkey as unit_id, concat(case when c.c_custkey % 97 = 0 then 'Tract 999999' else concat('Census Tract ', cast(1 + c.c_custkey % 9990 as varchar), case when c.c_custkey % 3 = 0 then concat('.', lpad(cast(1 + c.c_custkey % 20 as varchar),2,'0')) else '' end) end,
 ', ', n.n_name, case c.c_custkey % 5 when 0 then ' County' when 1 then ' Parish' when 2 then ' Borough' when 3 then ' city' else ' Municipality' end, ', ', r.r_name) as trt_string
from customer c join nation n on c.c_nationkey=n.n_nationkey join region r on n.n_regionkey=r.r_regionkey""",
    ),
    "f6s": (
        ["f6"],
        "select unit_id, metro_id, x + cast(unit_id::bigint * unit_id * 7919 % 1009 as double) / 1009 / 200 as x, y + cast(unit_id::bigint * unit_id * 104729 % 997 as double) / 997 / 200 as y from f6",
    ),
    "f6": (
        [],
        "select c_custkey as unit_id, c_nationkey as metro_id, ((c_custkey*37)%1000 + 0.5e0) / 2e2 as x, ((c_custkey*91)%1000 + 0.5e0) / 2e2 as y from customer",
    ),
    "f7": (
        [],
        """select c_custkey as serial, c_nationkey as met_id, case c_custkey % 3 when 0 then 2000 when 1 then 2010 else 2016 end as yr,
 case c_mktsegment when 'AUTOMOBILE' then 1 when 'BUILDING' then 2 when 'FURNITURE' then 5 when 'HOUSEHOLD' then 1 else 8 end as race,
 case c_mktsegment when 'HOUSEHOLD' then 1 else 0 end as hispan,
 1 + c_custkey % 7 as perwt, 1 + c_custkey % 5 as hhwt, c_acctbal as hhincome, c_custkey % 200 as bpl, c_custkey % 81 as occscore, c_custkey % 97 as sei from customer""",
    ),
    "f8": (
        [],
        """select o.o_custkey as res_id, l.l_suppkey as pow_id, sum(l_quantity) as total_est,
 coalesce(sum(case when o_orderpriority='1-URGENT' then l_quantity end),0) as nhw_est,
 coalesce(sum(case when o_orderpriority<>'1-URGENT' then l_quantity end),0) as oth_est
from lineitem l join orders o on l_orderkey=o_orderkey group by 1,2""",
    ),
    "f9": (
        [],
        """select o_custkey as unit_id, case o_orderstatus when 'F' then 'res' when 'O' then 'pow' else 'res' end as type,
 case when o_orderkey % 11 = 0 then 'Total' when o_orderkey % 13 = 0 then 'No earnings' when o_totalprice < 60000 then '$1 to $9,999 or loss'
  when o_totalprice < 140000 then '$10,000 to $14,999' when o_totalprice < 200000 then '$15,000 to $24,999' when o_totalprice < 280000 then '$25,000 to $34,999'
  when o_totalprice < 340000 then '$35,000 to $49,999' when o_totalprice < 420000 then '$50,000 to $74,999' else '$75,000 or more' end as earnings_str,
 concat(cast(1 + o_orderkey % 3 as varchar), ',', lpad(cast(o_orderkey % 1000 as varchar),3,'0')) as value from orders""",
    ),
    "f10": (
        [],
        """select o_custkey as unit_id, case l_linestatus when 'F' then 'res' else 'pow' end as type,
 case l_linenumber when 1 then '16 and 17 years' when 2 then '18 to 20 years' when 3 then '25 to 44 years' when 4 then '45 to 59 years' when 5 then '60 to 64 years' when 6 then '65 to 74 years' else '75 years and over' end as age,
 case when l_suppkey % 2 = 0 then 'Male' else 'Female' end as sex,
 case l_returnflag when 'A' then 'Speak only English' when 'N' then 'Spanish' else 'Other language' end as lang,
 case l_partkey % 3 when 0 then 'Below 100 percent of the poverty level' when 1 then '100 to 149 percent of the poverty level' else 'At or above 150 percent of the poverty level' end as pov_status,
 l_quantity as value from lineitem join orders on l_orderkey=o_orderkey""",
    ),
}


def with_ctes(body: str, *names: str) -> str:
    """The body preceded by the named tables and whatever they build on."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in CTES[name][0]:
            visit(need)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    heads = ",\n".join(f"{n} as materialized ({CTES[n][1]})" for n in order)
    body = body.strip()
    if body.lower().startswith("with "):
        return f"with {heads},\n{body[5:]}"
    return f"with {heads}\n{body}"


def entropy_sql(parts: list[str]) -> str:
    return " + ".join(f"case when {p} = 0 then 0e0 else {p} * ln(1e0 / nullif({p}, 0)) end" for p in parts)


