"""Readers on files with awkward shapes."""

import random

import pytest
from pyspark.sql import functions as F

from diurnal.sources import extracts, tables


def test_preamble_is_dropped_once_per_file_not_per_split(spark, tmp_path):
    """Files far larger than a split, several files in one task, different skips, an empty file."""
    for name, skip, n in [("2000_workplace", 4, 5000), ("2006_2010_residence", 3, 3), ("2012_2016_residence", 3, 0)]:
        lines = ["note, x"] * skip + ["label,n,"] + ["extra,9,"] * 4 + [f'"T {i}, a","1,{i:03d}",' for i in range(n)]
        (tmp_path / f"{name}.csv").write_text("\r\n".join(lines) + "\r\n")
    (tmp_path / "2000_empty.csv").write_text("")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        skip = F.when(F.col("file").contains("2000_"), 4).otherwise(3)
        df = extracts.read_extracts(
            spark, str(tmp_path), "label string, n string, empty string", skip, extra_rows=4, drop=["empty"]
        ).withColumns({"type": extracts.side_of("file"), "year": extracts.period_of("file")})
        assert df.rdd.getNumPartitions() > 4
        got = {(r["year"], r["type"]): (r["c"], r["u"]) for r in df.groupBy("year", "type").agg(
            F.count("*").alias("c"), F.count_distinct("label").alias("u")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {("2000", "pow"): (5000, 5000), ("2006-2010 ACS", "res"): (3, 3)}
    assert df.filter("label like 'extra%' or label like 'note%'").count() == 0


def test_latin1_file(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("skip\nDoña Ana County,5\n".encode("latin-1"))
    df = extracts.read_extracts(spark, str(tmp_path), "label string, n string", F.lit(0), latin1=True)
    assert [tuple(r)[1:] for r in df.collect()] == [("Doña Ana County", "5")]


def test_multi_polygon(spark, tmp_path):
    (tmp_path / "layer.json").write_text(
        '{"type":"Feature","properties":{"k":1},"geometry":{"type":"MultiPolygon","coordinates":'
        "[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]}}\n"
        '{"type":"Feature","properties":{"k":2},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}}\n'
    )
    df = tables.read_boundaries(spark, str(tmp_path), "k:int")
    assert {r["k"]: len(r["rings"]) for r in df.collect()} == {1: 2, 2: 1}


def test_csv_sink(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, "2000"), (None, None, "2000")], "k string, x double, year string")
    tables.write_table(df, str(tmp_path / "t"), format="csv")
    back = tables.read_table(spark, str(tmp_path / "t"), "k string, x double, year string", format="csv")
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)


def by_csv(path, skip):
    import csv
    import io

    text = path.read_text(newline="")
    body = text.split("\n", skip)[skip]
    return [tuple(r) for r in csv.reader(io.StringIO(body, newline=""), doublequote=True) if r]


@pytest.mark.parametrize("split", [64, 500, 1 << 20])
def test_line_breaks_and_doubled_quotes_inside_fields(spark, tmp_path, split):
    """Quoted fields over many lines, over several splits, with commas, blank lines and quotes in them."""
    rng = random.Random(split)
    for name in ("a", "b"):
        rows = []
        for i in range(300):
            piece = lambda: "".join(rng.choice(["x", " ", ",", "\n", '"', "\n\n", "yz", "\\", "1"]) for _ in range(rng.choice([0, 2, 9, 60])))
            quoted = lambda v: '"' + v.replace('"', '""') + '"'
            rows.append(f"{i},{quoted('f' + piece())},{quoted('g' + piece() + 'h')}")
        (tmp_path / f"{name}.csv").write_text('a note with a "quote\nid,f,g\n' + "\n".join(rows) + ("\n" if name == "a" else ""), newline="")
    (tmp_path / "c.csv").write_text('note\nid,f,g\n1,"open\n\n\nand closed",z\n', newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        df = extracts.read_extracts(spark, str(tmp_path), "id string, f string, g string", F.lit(1))
        got = {}
        for r in df.collect():
            got.setdefault(r["file"], []).append(tuple(r)[1:])
        parts = df.inputFiles() and spark.read.text(str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name in ("a.csv", "b.csv", "c.csv"):
        assert sorted(got[name]) == sorted(by_csv(tmp_path / name, 2))
    assert parts > 20 or split > 64


def test_a_quote_that_is_never_closed_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text('h\n1,"open\n' + "2,x\n" * 50)
    lines = extracts.read_lines(spark, str(tmp_path), F.lit(1), most_lines=20)
    with pytest.raises(Exception, match="a quote is not closed in a.csv"):
        lines.collect()


def test_only_broken_records_are_moved(spark, tmp_path):
    """Lines that are whole records stay in their split: the shuffle holds the others and one row a split."""
    (tmp_path / "a.csv").write_text("h\n" + "1,plain\n" * 2000 + '2,"two\nlines"\n')
    lines = extracts.read_lines(spark, str(tmp_path), F.lit(1))
    assert lines.count() == 2001
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [file") == 1 and "Filter" in plan
