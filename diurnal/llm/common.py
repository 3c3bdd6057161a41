"""Shared steps of the operators: tables, written intermediates, Arrow batches."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from diurnal.session import scratch_dir

#: ASCII white space, the word and line separator of all operators: space and 0x09-0x0D.
BLANKS = b" \t\n\x0b\x0c\r"

#: Rows of an Arrow batch sent to a task.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of one Arrow batch that a task hands back at once are cut near this many bytes.
OUT_BYTES = 16 << 20


def prepare(spark: SparkSession) -> None:
    """Set the session up for operators with Python workers.

    Workers on this machine may import this package from where it lies (on a cluster install it
    on the executors or pass it with ``--py-files``). Texts are long rows, so Arrow batches
    hold fewer of them, unless the session has a setting of its own.
    """
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])
    if spark.conf.get(_BATCH) == "10000":  # Spark's default
        spark.conf.set(_BATCH, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_once(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read back: cuts lineage, computes once."""
    path = f"{scratch_dir(df.sparkSession, name)}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_remainder(column: str, divisor: int):
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def sample_by_hash(rows: DataFrame, group: str, key: str, n: int, total: str | None = None) -> DataFrame:
    """The ``n`` rows of each group with the smallest hash of ``key``; groups are few.

    With ``total``, a column of this name has the number of all rows of the row's group.

    Counts of the groups first give a hash below which about 2 n rows of each lie, so that
    the ordering sees no more than these, however large a group is.
    """
    counts = {r[group]: r["count"] for r in rows.where(F.col(group).isNotNull()).groupBy(group).count().collect()}
    hashed = rows.withColumn("_hash", F.xxhash64(key))
    below, size = F.lit(False), F.lit(None).cast("long")
    for value, count in counts.items():
        top = min(2**63 - 1, int(-(2**63) + 2**64 * min(1.0, 2 * n / count)))
        below = below | ((F.col(group) == value) & (F.col("_hash") <= F.lit(top)))
        size = F.when(F.col(group) == value, F.lit(count)).otherwise(size)
    order = Window.partitionBy(group).orderBy("_hash", key)
    near = hashed.where(below).withColumn("_place", F.row_number().over(order))
    near = near.where(F.col("_place") <= n).drop("_hash", "_place")
    return near.withColumn(total, size) if total else near


def utf8(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as UTF-8 bytes, null as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut incoming batches so that the texts of one piece stay near ``OUT_BYTES``."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, min(n, int(OUT_BYTES / max(1, batch.nbytes) * n)))
        for at in range(0, n, step):
            yield batch.slice(at, step)
