"""Order-insensitive comparison of a Spark result with SQL run by DuckDB."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _key(v):
    if v is None:
        return "~null"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if v == 0 and math.copysign(1, v) < 0:
            return "-0.0"
        return repr(v)
    return f"{type(v).__name__}:{v}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_key(r[i]) for i in order) for r in rows)


def difference(spark_df, con, sql) -> str | None:
    """None when equal, else a short description."""
    got_cols = spark_df.columns
    got = [tuple(r) for r in spark_df.collect()]
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = rows_of(got_cols, got), rows_of(want_cols, want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ ({sorted(got_cols)}): {bad[0][0]} != {bad[0][1]}"
    return None
