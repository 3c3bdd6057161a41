"""Hot keys: what is copied, what is dealt out, and how long windows get."""

import random

import pytest
from pyspark.sql import functions as F

from diurnal.operators import joins, order
from diurnal.plans.analyses import od_flows


def test_only_hot_groups_are_copied(no_broadcast):
    """One key with a third of the rows beside millions of cold ones: the table stays its own size."""
    spark = no_broadcast
    cold = 3_000_000
    rows = spark.range(cold).selectExpr("if(id % 3 = 0, -1, id) as k", "id")
    table = spark.range(-1, cold).selectExpr("id as k", "id * 2 as v")
    hot = joins.hot_keys(rows, ["k"])
    parts = {r[joins._HASH]: r[joins._PARTS] for r in hot.collect()}
    only = spark.range(1).select(F.xxhash64(F.lit(-1).cast("bigint"))).first()[0]
    assert set(parts) == {only} and 333 <= parts[only] <= 335
    copies = joins.salted(table, ["k"], hot)
    assert copies.count() < 1.1 * (cold + 1)
    dealt = joins.salted(rows, ["k"], hot, ["id"]).groupBy("k", joins._SALT).count()
    assert dealt.agg(F.max("count")).first()[0] < 1.3 * cold / joins.HOT_PART
    joined = joins.attach(rows, table, ["k"], ["id"])
    assert joined.filter("v = 2 * k").count() == cold


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_hot_and_null_keys_join_alike_however_large_the_table(spark, how, request):
    rng = random.Random(3)
    draw = lambda: rng.choice([None, 1, 1, 1, 2, 3, rng.randrange(10, 400)])
    rows = spark.createDataFrame([(draw(), draw(), i) for i in range(3000)], "a int, b int, i int")
    table = spark.createDataFrame([(a, b, a or 0) for a in (None, 1, 2, *range(10, 200)) for b in (None, 1, 3, 50)] + [(1, 1, 9)], "a int, b int, v int")
    small = sorted(joins.attach(rows, table, ["a", "b"], ["i"], how).collect(), key=str)
    request.getfixturevalue("no_broadcast")
    large = sorted(joins.attach(rows, table, ["a", "b"], ["i"], how).collect(), key=str)
    assert small == large and large


def test_no_rows_no_hot_keys(spark):
    assert joins.hot_keys(spark.createDataFrame([], "k int"), ["k"]).count() == 0


def filled(rows):
    out, last = [], {}
    for k, p, v, w in sorted(rows):
        a, b = last.get(k, (None, None))
        last[k] = (v if v is not None else a, w if w is not None else b)
        out.append((k, p, *last[k]))
    return out


@pytest.mark.parametrize("bin_rows", [50, 700, 10**6])
def test_fill_down_over_one_long_history(spark, bin_rows):
    """A key with nine tenths of the rows, long stretches without a value, keys without any."""
    rng = random.Random(5)
    rows = []
    for p in range(3000):
        k = 1 if rng.random() < 0.9 else rng.randrange(2, 9)
        v = p if rng.random() < 0.01 and k != 7 else None
        rows.append((k, p, v, -p if rng.random() < 0.3 else None))
    df = spark.createDataFrame(rows, "k int, p int, v int, w int").repartition(8)
    got = order.fill_down(df, ["k"], ["p"], ["v", "w"], bin_rows=bin_rows)
    assert sorted(map(tuple, got.select("k", "p", "v", "w").collect())) == filled(rows)


def test_fill_down_windows_stay_bounded(spark):
    df = spark.range(40_000).selectExpr("if(id % 10 = 0, id % 7, -1) as k", "id as p", "if(id % 997 = 0, id, null) as v")
    out = order.fill_down(df, ["k"], ["p"], ["v"], bin_rows=1000)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "windowspecdefinition" in line]
    assert len(windows) == 2  # inside ranges by place, and over the ranges of a key
    assert any("_place" in w and "_bin" in w for w in windows) and all("_bin" in w for w in windows)
    assert out.filter("k = -1 and v is null and p > 997").count() == 0


@pytest.fixture
def counted(no_broadcast, monkeypatch):
    """Plans of the tables in which hot keys are looked for."""
    plans = []
    look = joins.hot_keys
    monkeypatch.setattr(joins, "hot_keys", lambda rows, keys: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or look(rows, keys))
    return plans


def test_flows_are_computed_once_for_both_ends(spark, counted):
    flows = spark.range(200).selectExpr("id % 7 as res_id", "id % 5 as pow_id", "1.0 as n").groupBy("res_id", "pow_id").agg(F.sum("n").alias("n"))
    places = spark.createDataFrame([(i, i % 2) for i in range(6)], "id long, metro_id long")
    got = joins.join_both_ends(flows, places, "id")
    assert sum(r["n"] for r in got.collect()) == 200 and got.count() == 35
    assert got.filter("res_id = 6 and res_metro_id is null").count() == 5
    assert len(counted) == 2 and not any("Aggregate" in p or "Join" in p for p in counted)


def test_flows_meet_metros_before_the_rows_of_their_ends(spark, counted):
    """Labels that stand for many tracts repeat only the flows inside a metro."""
    flows = spark.createDataFrame([("a", "b", 5.0, 2.0, 3.0), ("a", "c", 5.0, 2.0, 3.0), (None, "b", 4.0, 4.0, 0.0), ("d", "b", 9.0, 9.0, 9.0)], "res_id string, pow_id string, total_est double, nhw_est double, oth_est double")
    ends = spark.createDataFrame([("a", 1, 0.1), ("a", 1, 0.2), ("a", 2, 0.3), ("b", 1, 1.0), ("c", 3, 2.0), (None, 1, 7.0), ("d", None, 8.0), ("b", None, 9.0)], "id string, metro_id int, x double")
    home = spark.createDataFrame([("a", "P", "Q")], "res_id string, pm_cat string, am_cat string")
    work = spark.createDataFrame([("b", "W"), ("b", "V"), ("c", "W")], "pow_id string, cat string")
    got = sorted((r["res_id"] or "", r["res_x"], r["pow_x"], r["pm_cat"] or "", r["cat"], r["name"], r["value"]) for r in od_flows(flows, ends, home, work).collect())
    inside = [("a", x, 1.0, "P", w, n, v) for x in (0.1, 0.2) for w in ("V", "W") for n, v in (("nhw_est", 2.0), ("oth_est", 3.0))]
    assert got == sorted(inside + [("", 7.0, 1.0, "", w, "nhw_est", 4.0) for w in ("V", "W")])
    assert len(counted) == 4 and not any("Join" in p for p in counted)
