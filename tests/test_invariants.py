"""Facts that hold for any counts."""

import math

import pytest
from pyspark.sql import functions as F

from diurnal.catalog import fixtures as fx
from diurnal.catalog import measures
from diurnal.functions.composition import GROUPS
from diurnal.operators import segregation
from diurnal.plans.analyses import with_entropy
from diurnal.session import settle


@pytest.fixture(scope="module")
def typed(spark, sf):
    return settle(fx.typed(spark, sf))


def extremes(df, expr):
    return df.agg(F.min(expr), F.max(expr)).first()


def test_shares_and_changes(typed):
    for side in ("am", "pm"):
        low, high = extremes(typed, sum(F.col(f"trt_shr_{g}_{side}") for g in GROUPS))
        assert low == pytest.approx(1) and high == pytest.approx(1)
    low, high = extremes(typed, sum(F.col(f"chg_{g}") for g in GROUPS))
    assert abs(low) < 1e-12 and abs(high) < 1e-12


def test_entropy_is_bounded(typed):
    low, high = extremes(with_entropy(typed), F.col("race_eth_div_am"))
    assert low >= 0 and high <= math.log(5) + 1e-12


def test_segregation_is_bounded(spark, sf, typed):
    d = measures.msr_dissimilarity_window(spark, sf)
    for name in measures.PAIRS:
        low, high = extremes(d, F.col(name))
        assert 0 <= low and high <= 1
    h = segregation.information_index([f"res_{g}_est" for g in ("nha", "nhb", "h", "nhw")])
    minority = sum(F.col(f"res_{g}_est") for g in ("nhb", "nha", "h", "nho"))
    by_metro = typed.groupBy("metro_id", "year").agg(
        h.alias("h"),
        segregation.isolation(minority, "res_nhw_est").alias("xpx"),
        (F.sum(minority) / F.sum("res_total_est")).alias("share"),
    )
    low, high = extremes(by_metro, F.col("h"))
    assert -1e-12 <= low and high <= 1 + 1e-12
    assert by_metro.filter(F.col("xpx") < F.col("share") - 1e-9).count() == 0


def test_transition_rows_sum_to_one(spark, sf):
    rows = measures.msr_transition_matrix(spark, sf).groupBy("year", "pm_cat").agg(F.sum("shr").alias("s"), F.max("total").alias("t"))
    assert all(r["s"] == pytest.approx(1, abs=1e-5) if r["t"] else r["s"] == 0 for r in rows.collect())


def test_reallocation_conserves_totals(spark, sf):
    u = fx.units(spark, sf)
    cw = fx.crosswalk(spark, sf).filter("to_id is not null")
    weights = cw.groupBy("from_id").agg(F.sum("weight").alias("w"))
    moved = segregation.reallocate(u, cw, "unit_id", "from_id", "to_id", "weight", ["res_total_est"])
    want = u.join(weights, u.unit_id == weights.from_id).agg(F.sum(F.col("res_total_est") * F.col("w"))).first()[0]
    assert moved.agg(F.sum("res_total_est")).first()[0] == pytest.approx(want)
