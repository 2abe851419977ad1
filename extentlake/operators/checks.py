"""Integrity checks; every check gives rows (code, kind, entity)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def violation(df: DataFrame, code: str, kind: str, entity: Column) -> DataFrame:
    return df.select(F.lit(code).alias("code"), F.lit(kind).alias("kind"), entity.cast("string").alias("entity"))


def checksum_algorithm(extents: DataFrame, expected: str = "blake3") -> DataFrame:
    """E2: only extents that have a checksum are judged."""
    return violation(extents.where((F.col("checksum") != "") & (F.col("checksum_alg") != expected)), "E2", "extent", F.col("extent_no"))


def positive_length(extents: DataFrame) -> DataFrame:
    return violation(extents.where(F.col("length") <= 0), "E3", "extent", F.col("extent_no"))


def dangling_files(extents: DataFrame, files: DataFrame) -> DataFrame:
    return violation(extents.join(files.select("file_id"), "file_id", "left_anti"), "M1", "extent", F.col("extent_no"))


def dangling_disks(extents: DataFrame, disks: DataFrame) -> DataFrame:
    known = disks.select(F.col("disk_id").alias("data_disk"))
    return violation(extents.join(known, "data_disk", "left_anti"), "M2", "extent", F.col("extent_no"))


def duplicate_extents(extents: DataFrame) -> DataFrame:
    """M3: a row for every occurrence after the first. Counted before the shuffle, so one hot id costs one row per task."""
    again = extents.groupBy("extent_no").agg(F.count("*").alias("c")).where("c > 1")
    return violation(again.select("extent_no", F.explode(F.sequence(F.lit(2), F.col("c")))), "M3", "extent", F.col("extent_no"))


def group_references(extents: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """P1 in both directions: extents whose group is unknown, members whose extent is unknown. No group ('') is skipped."""
    lost = extents.where("pg IS NOT NULL").join(groups.select("pg"), "pg", "left_anti")
    lost = lost.select(F.lit("P1").alias("code"), F.col("extent_no").cast("string").alias("entity"), F.col("pg").cast("string").alias("ref"))
    gone = members.join(extents.select("extent_no"), "extent_no", "left_anti")
    gone = gone.select(F.lit("P1").alias("code"), F.col("pg").cast("string").alias("entity"), F.col("extent_no").cast("string").alias("ref"))
    return lost.unionByName(gone)


def aliased_members(extents: DataFrame) -> DataFrame:
    """P4: members of a group that share a disk with an earlier member (groups are bounded by their width)."""
    w = W.partitionBy("pg", "data_disk").orderBy("extent_no")
    x = extents.withColumn("first", F.first("extent_no").over(w)).withColumn("k", F.row_number().over(w)).where("k > 1")
    return x.select(F.lit("P4").alias("code"), F.col("pg").alias("entity"), "first", F.col("extent_no").alias("dup"))


def all_checks(named: list[tuple[int, DataFrame]]) -> DataFrame:
    """Violations per check, in the order in which checks run; checks without any are absent."""
    rows = reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("check_order"), "code") for k, df in named])
    return rows.groupBy("check_order", "code").agg(F.count("*").alias("n"))


def extent_content(extents: DataFrame, blobs: DataFrame) -> DataFrame:
    """E1: the first thing wrong with an extent's bytes: missing, length, digest. Extents without a checksum are skipped."""
    x = extents.where("checksum <> ''").join(blobs, "extent_no", "left")
    reason = F.when(F.col("content").isNull(), "missing").when(F.length("content") != F.col("stored_length"), "length").when(F.sha2("content", 256) != F.col("checksum"), "digest")
    return x.select(F.col("extent_no").cast("string").alias("entity"), reason.alias("reason")).where("reason IS NOT NULL")


def lower_generation(snapshots: DataFrame) -> DataFrame:
    """Snapshots whose transaction count is below that of the snapshot before them in their own pool."""
    w = W.partitionBy("pool").orderBy("seq")
    return snapshots.withColumn("prev", F.lag("gen").over(w)).where("gen < prev").select("seq", "gen", "prev")
