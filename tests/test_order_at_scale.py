"""The plans by ranges against NumPy, with most rows in one group and many equal values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from diurnal.operators import order


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(1)
    n = 6000
    g = np.where(rng.random(n) < 0.6, 0, rng.integers(1, 20, n))
    x = np.where(rng.random(n) < 0.35, 5.0, np.round(rng.lognormal(0, 2, n), 2))
    w = rng.integers(1, 6, n)
    rows = [(int(i), int(a), float(b), int(c)) for i, (a, b, c) in enumerate(zip(g, x, w))]
    return g, x, w, spark.createDataFrame(rows, "i int, g int, x double, w int").repartition(8)


@pytest.mark.parametrize("bin_rows", [100, 2000, 10**6])
def test_quantiles(no_broadcast, skewed, bin_rows):
    g, x, _, df = skewed
    got = {r["g"]: (r["a"], r["b"]) for r in order.quantiles(df, ["g"], "x", {"a": 0.25, "b": 0.5}, bin_rows=bin_rows).collect()}
    for k in np.unique(g):
        assert got[k] == pytest.approx(tuple(np.quantile(x[g == k], [0.25, 0.5])))


def test_ranks(no_broadcast, skewed):
    g, x, _, df = skewed
    got = {r["i"]: r["r"] for r in order.add_rank(df, ["g"], "x", "r", bin_rows=300).select("i", "r").collect()}
    for k in np.unique(g):
        v = x[g == k]
        want = [(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v]
        assert [got[i] for i in np.flatnonzero(g == k)] == pytest.approx(want)


def test_weighted_medians(no_broadcast, skewed):
    g, x, w, df = skewed
    got = {r["g"]: r["m"] for r in order.weighted_medians(df, ["g"], "x", "w", "m", bin_rows=300).collect()}
    for k in np.unique(g):
        v, u = x[g == k], w[g == k]
        o = np.lexsort((u, v))
        v, u = v[o], u[o]
        c = np.cumsum(u) - u / 2
        assert got[k] == pytest.approx(float(np.interp(u.sum() / 2, c, v)))


def test_windows_stay_bounded_with_one_group_of_most_rows(spark):
    """Nine tenths of the rows in one group, all values different: no window holds much more than a range."""
    df = spark.range(40_000).selectExpr("if(id % 10 = 0, id % 7, -1) as g", "hash(id) as x")
    known, totals = order._ranges(df, ["g"], ["x"], None, 1000)
    assert known.groupBy("g", "_bin").count().agg(F.max("count")).first()[0] <= 3000
    t = order.running_totals(df, ["g"], "x", bin_rows=1000)
    plan = t._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "windowspecdefinition" in line and " x#" in line]
    assert windows and all("_bin" in line for line in windows)
    assert t.agg(F.sum("_n")).first()[0] == 40_000
    assert t.groupBy("g").agg((F.max("_n_before") + 1 == F.max("_n_all")).alias("ok")).filter("not ok").count() == 0
