"""Session settings, the shared scratch folder, and measured tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_local_scratch: dict[str, str] = {}


def local_session(cores: int | str = 8, app: str = "diurnal") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession, name: str = "table") -> str:
    """A fresh path below the folder the cluster names in ``spark.checkpoint.dir``.

    A machine-local folder is used only in local mode, where that setting may be absent.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        app = spark.sparkContext.applicationId
        base = _local_scratch.setdefault(app, tempfile.mkdtemp(prefix="diurnal-"))
    return f"{base}/diurnal/{name}-{uuid.uuid4().hex}"


def _row_bytes(schema: T.StructType) -> Column:
    """Bytes of a row in memory: eight per field, and the contents of those that vary."""
    size = F.lit(16 + 8 * len(schema.fields))
    for field in schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            # their JSON is about half as large as nested rows of eight-byte fields
            size = size + 2 * F.coalesce(F.octet_length(F.to_json(c)), F.lit(0))
    return size.cast("long")


def settle(df: DataFrame) -> DataFrame:
    """Write a derived table once and read it back.

    Writing computes a table that is read several times once, and cuts lineage: a lost executor
    re-reads the files instead of repeating an aggregation.
    """
    return measured(df)[0]


def measured(df: DataFrame) -> tuple[DataFrame, int]:
    """A settled table with its size in memory in bytes, counted while it is written.

    Catalyst's estimates cannot bound a table above a generator (it inherits its input's
    size, however many rows it makes), and file sizes are those of compressed data.
    """
    path = scratch_dir(df.sparkSession, "settled")
    seen = Observation()
    counted = df.observe(seen, F.sum(_row_bytes(df.schema)).alias("bytes"))
    counted.write.parquet(path)
    _delete_at_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["bytes"] or 0


def _delete_at_end(spark: SparkSession, path: str) -> None:
    """Have a written folder deleted when the driver ends; until then later steps may read it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)


def broadcast_limit(spark: SparkSession) -> int:
    """Largest size in memory of a table that may be broadcast; negative for none."""
    return spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
