"""Disk lifecycle, targeted checks, merges after replay, and the protection simulator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_disk(extents: DataFrame, old: int, new: int) -> DataFrame:
    return extents.withColumn("data_disk", F.when(F.col("data_disk") == old, new).otherwise(F.col("data_disk")))


def fail_disk(disks: DataFrame, disk_id: int) -> DataFrame:
    return disks.withColumn("health", F.when(F.col("disk_id") == disk_id, "failed").otherwise(F.col("health")))


def updated(extents: DataFrame, news: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` takes the new value where ``news`` has the key (UPDATE ... FROM)."""
    return extents.join(news.select(key, F.col(column).alias("_new")), key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def targeted(violations: DataFrame, touched: DataFrame) -> DataFrame:
    """Violations of touched entities only; the filter stands before the checks' own reading of blobs in a plan."""
    return violations.join(touched.select(F.col("entity").cast("string").alias("entity")).distinct(), "entity", "left_semi")


def touched_extents(extents: DataFrame, new: DataFrame) -> DataFrame:
    """Committed extents of the groups that new extents join: what must be sound before parity is computed anew."""
    return extents.join(new.select("pg").distinct(), "pg", "left_semi").join(new.select("extent_no"), "extent_no", "left_anti")


def stale_parity(stored: DataFrame, on_disk: DataFrame, affected: DataFrame) -> DataFrame:
    """Affected groups whose stored digest is missing, or differs from that of the file."""
    both = affected.select("pg").distinct().join(stored, "pg", "left").join(on_disk, "pg", "left")
    return both.where(F.col("stored").isNull() | F.col("found").isNull() | (F.col("stored") != F.col("found"))).select("pg")


def simulator(data_disks: int, extents: int, spark) -> DataFrame:
    """disk, idx, lane words of a seeded matrix of extents (digests of their coordinates, the same in any engine)."""
    words = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.conv(F.substr(F.sha2(F.concat_ws("|", F.lit("7"), "disk", "idx"), 256), j * 8 + 1, F.lit(8)), 16, 10).cast("long"))
    x = spark.range(data_disks * extents).select((F.col("id") % data_disks).alias("disk"), F.floor(F.col("id") / data_disks).alias("idx"))
    return x.select("disk", "idx", F.posexplode(words).alias("lane", "word"))


def simulate(matrix: DataFrame, corrupt_disk: int, corrupt_idx: int) -> DataFrame:
    """One row: mismatches, recoveries, all_healthy, parity_verified after one extent's first word was damaged."""
    hit = (F.col("disk") == corrupt_disk) & (F.col("idx") == corrupt_idx)
    now = matrix.withColumn("now", F.when(hit & (F.col("lane") == 0), F.col("word").bitwiseXOR(F.lit(255))).otherwise(F.col("word")))
    parity = matrix.groupBy("idx", "lane").agg(F.bit_xor("word").alias("parity"))
    sums = now.groupBy("idx", "lane").agg(F.bit_xor("now").alias("sum"))
    x = now.join(parity, ["idx", "lane"]).join(sums, ["idx", "lane"]).withColumn("rebuilt", F.col("parity").bitwiseXOR(F.col("sum")).bitwiseXOR(F.col("now")))
    per = x.groupBy("disk", "idx").agg(F.bool_or(F.col("now") != F.col("word")).alias("bad"), F.bool_and(F.col("rebuilt") == F.col("word")).alias("can"))
    return per.agg(F.count_if("bad").alias("mismatches"), F.count_if(F.col("bad") & F.col("can")).alias("recoveries"), F.bool_and(~F.col("bad") | F.col("can")).alias("all_healthy"))
