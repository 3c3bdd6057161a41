"""Connected components by star contraction, with written rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_once


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of all nodes that ``edges`` (a, b) touch.

    Alternates two steps until nothing changes: every node links its larger neighbours to
    its smallest one, then every node links its smaller neighbours to the smallest. Each
    round is written to the shared folder, so lineage stays short and a lost executor re-reads
    files. Groupings aggregate minima before any join; no neighbour list is collected. Both sides
    of each join are written tables, so that adaptive execution can split a hub's rows.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = write_once(links, "links")
    before = None
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = write_once(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = write_once(large, "large-star")
        low = write_once(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        links = write_once(small.where("u <> v").distinct(), "links")
        now = tuple(links.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
