"""Rules for missing values, joins and grids."""

import pytest
from pyspark.sql import functions as F

from diurnal.functions import nulls
from diurnal.functions.composition import entropy, type7, type9
from diurnal.operators import joins, order, reshape, segregation


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_strict_and_skipping_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 4.0)], "g string, x double")
    got = df.groupBy("g").agg(
        nulls.strict_sum("x").alias("s"),
        nulls.sum_or_zero(F.when(F.col("g") == "b", F.col("x"))).alias("z"),
        nulls.strict_avg("x").alias("m"),
        nulls.subset_avg("x", F.col("x") > 100).alias("empty"),
        nulls.count_distinct_with_null("x").alias("d"),
    )
    assert rows(got, "g", "s", "z", "m", "empty", "d") == [("a", None, 0.0, None, None, 2), ("b", 6.0, 6.0, 3.0, None, 2)]


def test_ratio_of_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (1.0, 4.0)], "a double, b double")
    assert rows(df.select(nulls.ratio("a", "b").alias("r")), "r") == [(0.25,), (None,), (None,)]


def test_group_constant_fails_on_two_values(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "g int, x string")
    with pytest.raises(Exception, match="not constant"):
        df.groupBy("g").agg(nulls.group_constant("x")).collect()


def test_types_at_thresholds(spark):
    cols = [f"trt_shr_{g}_pm" for g in ("nhw", "nhb", "h", "nha")]
    data = [
        (0.75, 0.25, 0.0, 0.0),
        (0.5, 0.5, 0.0, 0.0),
        (0.4, 0.5, 0.1, 0.0),
        (0.1, 0.1, 0.75, 0.05),
        (0.3, 0.3, 0.2, 0.2),
        (None, None, None, None),
        (0.2, 0.1, 0.1, 0.6),
    ]
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(data)], "i int, " + ", ".join(f"{c} double" for c in cols))
    got = [tuple(r) for r in df.orderBy("i").select(type7("pm"), type9("pm")).collect()]
    assert got == [
        ("Predominantly White", "Predominantly White"),
        ("White-Mixed", "White-Mixed"),
        ("Non-White-Mixed", "Black-Mixed"),
        ("Predominantly Latinx", "Predominantly Latinx"),
        ("Multiethnic", "Multiethnic"),
        ("Multiethnic", "Multiethnic"),
        ("Non-White-Mixed", "Asian-Mixed"),
    ]


def test_entropy(spark):
    df = spark.createDataFrame([(0.5, 0.5), (1.0, 0.0), (None, 1.0)], "p double, q double")
    got = [r[0] for r in df.select(entropy(["p", "q"])).collect()]
    assert got[0] == pytest.approx(0.6931471805599453) and got[1] == 0.0 and got[2] is None


@pytest.mark.parametrize("small", [True, False])
def test_null_keys_match(spark, small, request):
    if not small:
        request.getfixturevalue("no_broadcast")
    a = spark.createDataFrame([(None, 1), ("x", 2), ("y", 3)], "k string, v int")
    b = spark.createDataFrame([(None, 10), ("x", 20), ("x", 21)], "k string, w int")
    want = [("x", 2, 20), ("x", 2, 21), ("y", 3, None), (None, 1, 10)]
    assert rows(joins.natural_join(a, b), "k", "v", "w") == sorted(want, key=repr)
    assert rows(joins.attach(a, b, ["k"], ["v"]), "k", "v", "w") == sorted(want, key=repr)
    kept = joins.keep_matching(a, b, ["k"], ["v"])
    assert rows(kept, "v") == [(1,), (2,)]


def test_grid_keeps_missing_labels(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "x string, y int")
    assert len(joins.category_grid(df, ["x", "y"]).collect()) == 4


def test_average_ranks_of_three_way_tie(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 5.0), (4, 1.0), (5, None)], "i int, x double")
    got = dict(rows(order.add_rank(df, [], "x", "r", descending=True), "i", "r"))
    assert got == {1: 2.0, 2: 2.0, 3: 2.0, 4: 4.0, 5: None}


def test_top_keeps_ties(spark):
    df = spark.createDataFrame([("a", 3), ("a", 2), ("a", 2), ("a", 1), ("b", 9), ("b", None)], "g string, x int")
    assert rows(order.top_with_ties(df, 2, "x", ["g"]), "g", "x") == [("a", 2), ("a", 2), ("a", 3), ("b", 9)]
    assert rows(order.top_with_ties(df, 2, "x"), "g", "x") == [("a", 3), ("b", 9)]


def test_weighted_median_edges(spark):
    data = [
        ("even", 1.0, 1.0), ("even", 2.0, 1.0), ("even", 4.0, 1.0), ("even", 8.0, 1.0),
        ("one", 7.0, 3.0),
        ("heavy", 1.0, 100.0), ("heavy", 2.0, 1.0),
        ("zero", 5.0, 1.0), ("zero", 100.0, 0.0),
        ("null", None, 1.0), ("null", 1.0, 1.0),
    ]
    df = spark.createDataFrame(data, "g string, x double, w double")
    got = dict(rows(order.weighted_medians(df, ["g"], "x", "w", "m"), "g", "m"))
    assert got["even"] == 3.0 and got["one"] == 7.0 and got["zero"] == 5.0 and got["null"] is None
    assert got["heavy"] == pytest.approx(1 + (50.5 - 50) / (100.5 - 50))


def test_fill_down_with_a_hot_key(spark):
    data = [("k", "p1", "a"), ("k", "p1", "a")] + [("k", "p2", None)] * 50 + [("m", "p2", None)]
    df = spark.createDataFrame(data, "k string, p string, v string")
    got = order.fill_down(df, ["k"], ["p"], ["v"])
    assert got.groupBy("k", "v").count().orderBy("k").collect() == [("k", "a", 52), ("m", None, 1)]


def test_fill_down_follows_the_order_of_rows(spark):
    data = [("k", "p1", 1, None), ("k", "p1", 2, "a"), ("k", "p1", 3, None), ("k", "p2", 1, "b"), ("k", "p2", 2, None)]
    df = spark.createDataFrame(data, "k string, p string, side int, v string")
    got = order.fill_down(df, ["k"], ["p", "side"], ["v"]).orderBy("p", "side").collect()
    assert [r["v"] for r in got] == [None, "a", "a", "b", "b"]


def test_crosswalk_many_to_many(spark):
    counts = spark.createDataFrame(
        [("2000", "a", 10.0), ("2000", "a", 2.0), ("2000", "b", None), ("2000", "c", 8.0)], "year string, u string, x double"
    )
    cw = spark.createDataFrame(
        [("a", "A", 0.75), ("a", "B", 0.25), ("b", "B", 1.0), ("c", "A", 0.5), ("c", None, 0.5)],
        "f string, t string, w double",
    )
    got = segregation.reallocate(counts, cw, "u", "f", "t", "w", ["x"])
    assert rows(got, "u", "x") == [("A", 13.0), ("B", None)]


def test_missing_reference_row(spark):
    df = spark.createDataFrame([("m", "w", 2.0), ("m", "b", 1.0), ("n", "b", 1.0)], "g string, c string, x double")
    got = reshape.ratio_to_reference(df, ["g"], "c", "w", {"r": "x"})
    assert rows(got, "g", "c", "r") == [("m", "b", 0.5), ("m", "w", 1.0), ("n", "b", None)]


def test_one_area_metro_and_empty_group(spark):
    df = spark.createDataFrame(
        [("one", 1, 3.0, 4.0), ("none", 2, 0.0, 4.0), ("none", 3, 0.0, 5.0), ("two", 4, 1.0, 0.0), ("two", 5, 0.0, 1.0)],
        "m string, u int, a double, b double",
    )
    got = segregation.dissimilarity(df, ["m"], {"d": ("a", "b")}, ["u"])
    assert rows(got, "m", "d") == [("none", None), ("one", 0.0), ("two", 1.0)]
    h = df.groupBy("m").agg(segregation.information_index(["a", "b"]).alias("h"))
    assert dict(rows(h, "m", "h"))["two"] == pytest.approx(1.0)
    assert dict(rows(h, "m", "h"))["one"] == pytest.approx(0.0)
    assert dict(rows(h, "m", "h"))["none"] is None
