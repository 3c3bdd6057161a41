"""Plain tables, boundary layers, and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shapes import RINGS_TYPE


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: str) -> DataFrame:
    """Delimited files with a header line and a declared schema."""
    return spark.read.schema(schema).csv(paths, header=True, mode="PERMISSIVE")


def read_boundaries(
    spark: SparkSession, paths: str | Sequence[str], properties: str
) -> DataFrame:
    """Polygon layer from GeoJSON features, one per line, as attributes and ``rings``.

    The parts of a multi-polygon become one list of rings; even-odd tests treat them as the
    union they are.
    """
    schema = f"properties struct<{properties}>, geometry struct<type:string,coordinates:string>"
    features = spark.read.schema(schema).json(paths)
    text = F.col("geometry.coordinates")
    single = F.from_json(text, "array<array<array<double>>>")
    many = F.flatten(F.from_json(text, "array<array<array<array<double>>>>"))
    rings = F.when(F.col("geometry.type") == "MultiPolygon", many).otherwise(single)
    as_points = F.transform(
        rings,
        lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))),
    )
    return features.select("properties.*", as_points.cast(RINGS_TYPE).alias("rings"))


def feature_json(rings: str, properties: Sequence[str]) -> Column:
    """A GeoJSON feature as text."""
    coordinates = F.transform(
        F.col(rings), lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))
    )
    return F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(*properties).alias("properties"),
            F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")).alias("geometry"),
        )
    )


def write_boundaries(df: DataFrame, path: str, rings: str = "rings") -> None:
    others = [c for c in df.columns if c != rings]
    df.select(feature_json(rings, others).alias("value")).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, partition: Sequence[str] = ("year",), format: str = "parquet") -> None:
    """Write a table partitioned by its filter columns."""
    writer = df.write.mode("overwrite").partitionBy(*partition)
    writer.parquet(path) if format == "parquet" else writer.csv(path, header=True)


def overwrite_periods(df: DataFrame, path: str, partition: Sequence[str] = ("year",)) -> None:
    """Replace only the partitions present in ``df``."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition)
        .parquet(path)
    )


def read_table(spark: SparkSession, path: str, schema: str, format: str = "parquet") -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.parquet(path) if format == "parquet" else reader.csv(path, header=True)
