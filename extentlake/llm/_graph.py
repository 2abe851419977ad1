"""Connected components of an edge table by alternating large and small stars; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch


def _lead(scratch: Scratch, links: DataFrame, tag: str) -> DataFrame:
    """u, v, m of directed links u-v with m the least of u and its v; hubs are split by the join, not gathered."""
    least = scratch.save(links.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), f"least-{tag}")
    return links.join(least, "u")


def components(scratch: Scratch, edges: DataFrame, tag: str) -> DataFrame:
    """node, comp (the smallest node reachable) for every node of the edges a-b."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, before, k = scratch.save(e, f"{tag}-0"), None, 0
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _lead(scratch, both, f"{tag}-{k}a").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large, f"{tag}-{k}l")
        small = _lead(scratch, large, f"{tag}-{k}b")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        k += 1
        old, e = f"{tag}-{k - 1}", scratch.save(small, f"{tag}-{k}")
        # Count and checksums of the links stop changing once every link is a node and the least node of its component.
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        scratch.drop(old, f"least-{tag}-{k - 1}a", f"{tag}-{k - 1}l", f"least-{tag}-{k - 1}b")
        if now == before or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
        before = now
