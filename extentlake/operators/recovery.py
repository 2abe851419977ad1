"""Recoverability, scrub and rebuild over presence and verdicts of extents and parity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def failed_disks(extents: DataFrame, groups: DataFrame) -> DataFrame:
    """A disk has failed when any file on it is missing: extents (data_disk, present), groups (parity_disk, present)."""
    lost = extents.where(~F.col("present")).select(F.col("data_disk").alias("disk_id"))
    return lost.unionByName(groups.where(~F.col("present")).select(F.col("parity_disk").alias("disk_id"))).distinct()


def multi_disk(extents: DataFrame, groups: DataFrame, strict: bool = False) -> DataFrame:
    """One row: failed disks, lost groups, lost and rebuildable extents, affected, present and lost bytes, possible, mode.

    ``strict`` counts a group as lost when two or more of its members and parity are on failed disks; otherwise only the
    parity disk decides, which reports two lost data disks of one group as recoverable.
    """
    failed = failed_disks(extents, groups)
    g = groups.join(failed.select(F.col("disk_id").alias("parity_disk"), F.lit(True).alias("parity_failed")), "parity_disk", "left").na.fill(False, ["parity_failed"])
    x = extents.join(failed.select(F.col("disk_id").alias("data_disk"), F.lit(True).alias("data_failed")), "data_disk", "left").na.fill(False, ["data_failed"])
    if strict:
        down = x.groupBy("pg").agg(F.count_if("data_failed").alias("down"))
        g = g.join(down, "pg", "left").withColumn("lost", F.coalesce("down", F.lit(0)) + F.col("parity_failed").cast("int") >= 2)
    else:
        g = g.withColumn("lost", F.col("parity_failed"))
    x = x.join(g.select("pg", "lost"), "pg", "left").na.fill(True, ["lost"])
    gone, bytes_ = F.col("data_failed") & F.col("lost"), lambda c: F.coalesce(F.sum(F.when(c, F.col("length"))), F.lit(0))
    a = x.agg(
        F.count_if(gone).alias("lost_extents"), F.count_if(F.col("data_failed") & ~F.col("lost")).alias("rebuildable_extents"), bytes_(gone).alias("lost_bytes"),
        bytes_(~F.col("present")).alias("affected_bytes"), bytes_(F.col("present")).alias("present_bytes"),
    )
    out = a.join(failed.agg(F.count("*").alias("failed_disks")), F.lit(True)).join(g.agg(F.count_if("lost").alias("lost_groups")), F.lit(True))
    return out.withColumn("possible", F.col("lost_extents") == 0).withColumn("mode", F.when(F.col("failed_disks") > 1, "dual").otherwise("single"))


def advice(row: dict[str, Column]) -> Column:
    """Which of the recommendations applies, first match."""
    return F.when(row["failed_disks"] == 0, "healthy").when(row["lost_extents"] > 0, "data loss").when(row["lost_groups"] > 0, "parity lost").when(row["failed_disks"] == 1, "rebuild one").otherwise("rebuild each")


def scrub(extents: DataFrame) -> DataFrame:
    """status, n, bytes over extents (length, reason, peers_ok, parity_ok): clean, healed by reconstruction, or failed."""
    status = F.when(F.col("reason").isNull(), "clean").when(F.col("parity_ok") & F.col("peers_ok"), "healed").otherwise("failed")
    return extents.groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


def rebuild_plan(extents: DataFrame, done: DataFrame) -> DataFrame:
    """disk_id, scanned, skipped, rebuilt, failed for all data disks in one job; extents in ``done`` (a checkpoint) are skipped."""
    x = extents.join(done.select("extent_no", F.lit(True).alias("skip")), "extent_no", "left").na.fill(False, ["skip"])
    bad = ~F.col("skip") & F.col("reason").isNotNull()
    can = F.col("parity_ok") & F.col("peers_ok")
    return x.groupBy(F.col("data_disk").alias("disk_id")).agg(
        F.count_if(~F.col("skip")).alias("scanned"), F.count_if("skip").alias("skipped"), F.count_if(bad & can).alias("rebuilt"), F.count_if(bad & ~can).alias("failed"),
    )


def rebuild_all(plan: DataFrame) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return plan.agg(F.count("*").alias("disks"), *[total(c) for c in ("scanned", "skipped", "rebuilt", "failed")], F.coalesce(F.bool_and(F.col("failed") == 0), F.lit(True)).alias("healthy"))
