"""Run named queries against their SQL: python tests/run_catalog.py SF_DIR [name part ...]

With NO_BROADCAST=1 nothing counts as small, so the plans for large tables are used.
"""

import os
import sys
import time

sys.path[:0] = [".", "tests"]

from compare import connect, difference

import __spark_entry__ as e
from diurnal.session import local_session

if __name__ == "__main__":
    sf, parts = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    if os.environ.get("NO_BROADCAST"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    con = connect(sf)
    oracles, bad = e.oracle_sql(), 0
    for name, f in e.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            df = f(spark, sf)
            if name in oracles:
                problem = difference(df, con, oracles[name])
                n = ""
            else:
                problem, n = None, f"rows {len(df.collect())} (no SQL)"
        except Exception as ex:
            problem, n = f"{type(ex).__name__}: {str(ex)[:1500]}", ""
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {n} {problem or ''}", flush=True)
    print("failures", bad)
