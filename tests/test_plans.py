"""Shape of the physical plans, with nothing small enough to broadcast."""

import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from diurnal import catalog
from diurnal.catalog import fixtures as fx
from diurnal.operators import joins, order
from diurnal.session import measured, scratch_dir, settle

QUERIES = catalog.QUERIES
CHECKED = [
    "jn_point_in_polygon",
    "jn_origin_dest",
    "jn_right_grid",
    "agg_mean_median",
    "win_top_n_ties",
    "msr_transition_matrix",
    "msr_dissimilarity_window",
    "msr_spatial_theil",
    "msr_crosswalk_realloc",
    "msr_od_flows",
    "geo_pair_kernel",
    "mdl_margins",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CHECKED)
def test_no_pairwise_joins_and_no_python(name, no_broadcast, sf):
    text = plan(QUERIES[name](no_broadcast, sf))
    assert not re.search("NestedLoop|Cartesian|EvalPython|InPandas|MapInArrow", text)


def test_scan_reads_only_needed_columns(spark, sf):
    text = plan(fx.typed(spark, sf).select("unit_id", "year", "pm_cat", "am_cat"))
    schemas = re.findall(r"ReadSchema: struct<(.*?)>", text)
    lines = [s for s in schemas if "l_orderkey" in s]
    assert lines and all(len(s.split(",")) == 3 for s in lines)


def test_filters_reach_the_scan(spark, sf):
    u = settle(fx.units(spark, sf))
    text = plan(u.filter((F.col("year") == "2000") & (F.col("res_total_est") > 0)).select("unit_id"))
    assert "EqualTo(year,2000)" in text and "GreaterThan(res_total_est,0.0)" in text


def test_top_n_per_group_is_cut_before_the_shuffle(spark, sf):
    u = settle(fx.units(spark, sf))
    text = plan(order.lowest_of_top(u, 3, "res_total_est", ["metro_id"]))
    assert re.search(r"WindowGroupLimit .*Partial", text)


def test_tables_above_a_generator_are_measured(spark):
    """Three million rows that Catalyst takes for a few bytes."""
    rows = spark.range(10).withColumn("k", F.col("id"))
    table = spark.range(1).select(F.expr("explode(sequence(0L, 400000L))").alias("k"), F.lit("x" * 50).alias("v"))
    assert measured(table)[1] > 400_000 * 50
    text = plan(joins.attach(rows, table, ["k"], ["id"]))
    assert "_salt" in text and "BroadcastHashJoin" not in text


def test_attach_salts_only_large_tables(spark, sf, no_broadcast):
    rows = fx.table(spark, sf, "customer")
    table = fx.table(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    assert "_salt" in plan(joins.attach(rows, table, ["c_nationkey"], ["c_custkey"]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    assert "_salt" not in plan(joins.attach(rows, table, ["c_nationkey"], ["c_custkey"]))


def test_wide_dimensions_take_one_shuffle(no_broadcast, sf):
    text = plan(QUERIES["jn_nway_wide"](no_broadcast, sf))
    joins_of_the_fixture = 2  # line items with their orders
    assert text.count("Exchange hashpartitioning") <= joins_of_the_fixture + 1


def test_settled_files_go_to_the_shared_folder(spark):
    def session(folder, master):
        conf = SimpleNamespace(get=lambda key, default=None: folder if key == "spark.checkpoint.dir" else default)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="app"))

    assert scratch_dir(session("hdfs://shared", "yarn")).startswith("hdfs://shared/")
    assert scratch_dir(spark) != scratch_dir(spark)
    assert scratch_dir(session(None, "local[2]"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(session(None, "yarn"))
