"""Text functions on literal edge cases."""

import pytest
from pyspark.sql import functions as F

from diurnal.functions import text


def values(spark, rows, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, x string")
    return [r["y"] for r in df.select("i", expr.alias("y")).orderBy("i").collect()]


def test_tract_codes(spark):
    names = ["Census Tract 7", "Census Tract 7.1", "Census Tract 1234.56", "Census Tract 12345", None]
    assert values(spark, names, text.tract_code("x")) == ["000700", "000701", "123456", "1234500", None]


def test_tract_label_parts(spark):
    rows = [
        "Census Tract 12.03, Prince George's County, Maryland",
        "Census Tract 1, Richmond city, Virginia",
        "Census Tract 5",
        "Tract 999999, X County, Ohio",
        "Census Tract 2, Ponce Municipio, Puerto Rico",
    ]
    df = spark.createDataFrame([(r,) for r in rows], "x string").select(text.parse_tract_label("x").alias("p"))
    got = [tuple(r) for r in df.select("p.*").collect()]
    assert got[0] == ("Census Tract 12.03", "001203", "Prince George's County", "Prince George's", "Maryland")
    assert got[1][2:] == ("Richmond city", "Richmond", "Virginia")
    assert got[2] == ("Census Tract 5", "000500", "", "", "")
    kept = df.select("p.*").filter(text.usable_tract("state", "trt_name"))
    assert [r["state"] for r in kept.collect()] == ["Maryland", "Virginia"]


@pytest.mark.parametrize(
    "label, expected",
    [
        ("No earnings", (0.0, 4999.0, "0_24999")),
        ("$1 to $9,999 or loss", (0.0, 4999.0, "0_24999")),
        ("$1 to $9,999", (0.0, 9999.0, "0_24999")),
        ("$25,000 to $34,999", (25000.0, 34999.0, "25000_49999")),
        ("$50,000 to $74,999", (50000.0, 74999.0, "50000_74999")),
        ("$75,000 or more", (75000.0, float("inf"), "75000_or_more")),
        ("unknown", (None, None, None)),
    ],
)
def test_earning_brackets(spark, label, expected):
    (got,) = values(spark, [label], text.earning_bounds("x"))
    assert tuple(got) == expected


def test_numbers(spark):
    rows = ["1,234", "+/-56", "-7.5%", "no number", "", None, "$1,000 to $2,000"]
    assert values(spark, rows, text.parse_number("x")) == [1234.0, -56.0, -7.5, None, None, None, 1000.0]


def test_padding_never_cuts(spark):
    assert values(spark, ["1", "12345", "", None], text.pad_left("x", 4)) == ["0001", "12345", "0000", None]


def test_split_pieces(spark):
    rows = ["a, b, c", "a", "", None]
    assert values(spark, rows, text.split_piece("x", ", ", 2, 2)) == ["b, c", "", "", None]


def test_slug_and_labels(spark):
    rows = ["St. Louis, MO-IL", "Miami-Fort Lauderdale, FL", "Nashville/Davidson Area, TN"]
    assert values(spark, rows, text.metro_slug("x")) == ["st_louis", "miami", "nashville_davidson_area"]
    df = spark.createDataFrame([(0.125, "a", None)], "s double, a string, b string")
    row = df.select(text.percent_label("s"), text.cross_label("a", "b"), text.keep_label("b", "x")).first()
    assert tuple(row) == ("13%", None, None)


def test_latin1(spark):
    df = spark.createDataFrame([(bytearray("Doña Ana".encode("latin-1")),)], "raw binary")
    assert df.select(text.decode_latin1("raw")).first()[0] == "Doña Ana"
    assert spark.range(1).select(F.lit("ok")).first()[0] == "ok"
