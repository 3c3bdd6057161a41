"""Every named query against its SQL."""

import pytest
from compare import connect, difference

import __spark_entry__ as entry_point
from diurnal import catalog

QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, con):
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        assert difference(df, con, ORACLES[name]) is None
    else:
        assert df.columns and df.collect() is not None


@pytest.mark.parametrize(
    "name", ["msr_dissimilarity_window", "agg_mean_median", "agg_weighted_median", "jn_in_lists", "win_rank_avg_ties"]
)
def test_query_without_broadcast(name, no_broadcast, sf, con):
    assert difference(QUERIES[name](no_broadcast, sf), con, ORACLES[name]) is None


def test_oracles_belong_to_queries():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    assert set(QUERIES) <= set(entry_point.queries())


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["year", "pm_cat", "am_cat", "n", "shr", "total"]
    assert df.count() > 0
