"""Capacity, protection and health rollups; sizes and shapes of the pool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ROLES, bucket_index


def pool_stats(disks: DataFrame, extents: DataFrame, files: DataFrame) -> DataFrame:
    """One row: capacity, free and used bytes, used share in basis points, extents, files, disks by role."""
    d = disks.agg(F.sum("capacity").alias("total_bytes"), F.sum("free").alias("free_bytes"), *[F.count_if(F.col("role") == r).alias(f"n_{r}") for r in ROLES])
    e = extents.agg(F.count("*").alias("extent_count"), F.sum("length").alias("extent_bytes"))
    used = F.col("total_bytes") - F.col("free_bytes")
    # In decimals: ten thousand times the bytes of a pool of an exabyte are beyond 64 bits.
    d = d.withColumn("used_bytes", used).withColumn("used_bp", F.when(F.col("total_bytes") > 0, F.expr("CAST(used_bytes AS DECIMAL(19, 0)) * 10000 div total_bytes")))
    # Three rows of one each: the product is one row.
    return d.join(e, F.lit(True)).join(files.agg(F.count("*").alias("file_count")), F.lit(True))


def disk_stats(disks: DataFrame, extents: DataFrame) -> DataFrame:
    """Extents and bytes on every disk, as data or as mirror; an extent counts once on a disk that holds both."""
    on = extents.select("length", F.explode(F.array_distinct(F.array("data_disk", "mirror_disk"))).alias("disk_id"))
    on = on.groupBy("disk_id").agg(F.count("*").alias("extents"), F.sum("length").alias("bytes"))
    return disks.select("disk_id").join(on, "disk_id", "left").na.fill(0, ["extents", "bytes"])


def disk_load(disks: DataFrame, extents: DataFrame) -> DataFrame:
    n = extents.groupBy(F.col("data_disk").alias("disk_id")).agg(F.count("*").alias("n"))
    return disks.select("disk_id").join(n, "disk_id", "left").na.fill(0, ["n"])


def pool_state(disks: DataFrame) -> Column:
    """Derived protection of the pool, over a rollup of disks by role."""
    return F.when(F.count("*") == 1, "integrity_only").when(F.count_if(F.col("role") == "parity") > 0, "parity").when(F.count_if(F.col("role") == "mirror") > 0, "mirrored").otherwise("integrity_only")


def protection_status(disks: DataFrame, extents: DataFrame) -> DataFrame:
    """Long form (metric, value): disks by role, extents by class, corrupt and quarantined extents, and the pool's state."""
    by_role = disks.groupBy(F.concat(F.lit("disks_"), "role").alias("metric")).agg(F.count("*").cast("string").alias("value"))
    cls = F.when(F.col("protection_class") == "", "checksum_only").otherwise(F.col("protection_class"))
    by_class = extents.groupBy(F.concat(F.lit("extents_"), cls).alias("metric")).agg(F.count("*").cast("string").alias("value"))
    bad = extents.where(F.col("corruption_status").isin("corrupt", "quarantined")).groupBy(F.col("corruption_status").alias("metric")).agg(F.count("*").cast("string").alias("value"))
    state = disks.agg(pool_state(disks).alias("value")).select(F.lit("pool_state").alias("metric"), "value")
    return by_role.unionByName(by_class).unionByName(bad).unionByName(state)


def statfs(disks: DataFrame, files: DataFrame, block: int = 4096) -> DataFrame:
    d = disks.agg(F.sum("capacity").alias("c"), F.sum("free").alias("f")).select(F.expr(f"c div {block}").alias("blocks"), F.expr(f"f div {block}").alias("bfree"))
    return d.join(files.agg(F.count("*").alias("files")), F.lit(True))


def health_summary(disks: DataFrame, startup_error: str = "") -> DataFrame:
    """Failed and degraded disks (any other status but online and none), and the alert level."""
    h = F.col("health")
    out = disks.agg(F.count_if(h == "failed").alias("failed"), F.count_if(~h.isin("", "online", "failed")).alias("degraded"))
    return out.withColumn("alert", F.when((F.col("failed") > 0) | F.lit(startup_error != ""), "critical").when(F.col("degraded") > 0, "warning").otherwise("ok"))


def histogram(samples: DataFrame, value: str = "micros") -> DataFrame:
    """Samples per latency bucket (not cumulative); the last bucket is the overflow."""
    return samples.groupBy(bucket_index(F.col(value)).alias("bucket_idx")).agg(F.count("*").alias("n"))


def group_width(disks: DataFrame, widest: int = 8) -> DataFrame:
    ready = F.count_if((F.col("role") == "data") & (F.lower("health") == "online") & (F.col("free") > 0))
    return disks.agg(F.least(F.greatest(ready, F.lit(1)), F.lit(widest)).alias("width"))


def counters(events: DataFrame) -> DataFrame:
    """Counter (events seen) and gauge (value of the latest event) per type."""
    return events.groupBy("event_type").agg(F.count("*").alias("counter"), F.max_by("micros", F.struct("ts", "event_id")).alias("gauge"))


def distinct_disks(extents: DataFrame) -> DataFrame:
    return extents.select(F.col("data_disk").alias("disk_id")).distinct()


def quorum(disks: DataFrame) -> DataFrame:
    """Integrity holds while at most one data disk is missing, and never without any data disk."""
    data = F.col("role") == "data"
    present, total = F.count_if(data & (F.col("health") != "failed")), F.count_if(data)
    return disks.agg(present.alias("present"), total.alias("total"), ((total > 0) & (present >= total - 1)).alias("intact"))


def status(disks: DataFrame, files: DataFrame, extents: DataFrame, journal: DataFrame, plan: DataFrame, violations: DataFrame, admission: DataFrame) -> DataFrame:
    """One row: health by admission, counts of the catalog, what recovery did, disks that aren't online, violations."""
    a = F.col("action")
    done = plan.agg((F.count_if(a.isin("abort", "roll-forward", "repair")) > 0).alias("journal_requires_replay"), F.count_if(a.isin("roll-forward", "repair")).alias("recovered_transactions"), F.count_if(a == "abort").alias("aborted_transactions"))
    down = F.when(~F.col("health").isin("", "online"), F.col("disk_id"))
    out = admission.select(F.when(F.col("status") == "refuse", "error").otherwise(F.col("status")).alias("status")).join(done, F.lit(True))
    out = out.join(disks.agg(F.array_join(F.sort_array(F.collect_set(down)).cast("array<string>"), ",").alias("failed_disks")), F.lit(True))
    for df, name in ((files, "managed_files"), (extents, "allocated_extents"), (journal, "journal_records"), (violations, "invariant_violations")):
        out = out.join(df.agg(F.count("*").alias(name)), F.lit(True))
    return out


def recovery_counts(plan: DataFrame, journal: DataFrame) -> DataFrame:
    """Attempted, recovered and aborted transactions of a recovery plan; journal records."""
    a = F.col("action")
    p = plan.agg(F.count_if(a.isin("abort", "roll-forward", "repair")).alias("attempted"), F.count_if(a.isin("roll-forward", "repair")).alias("recovered"), F.count_if(a == "abort").alias("aborted"))
    return p.join(journal.agg(F.count("*").alias("records")), F.lit(True))


def snapshot_digest(rows: DataFrame, pool: str, order: str, columns: list[str]) -> DataFrame:
    """pool, digest of its rows' canonical text, a line each in order (a pool's catalog is one value)."""
    line = F.concat_ws(":", *[F.col(c).cast("string") for c in columns])
    lines = F.array_sort(F.collect_list(F.struct(order, line.alias("line"))))
    return rows.groupBy(pool).agg(F.sha2(F.array_join(lines.getField("line"), "\n"), 256).alias("digest"))
