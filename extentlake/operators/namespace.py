"""Directory listing and pool assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import direct_child


def listing(files: DataFrame, prefix: str) -> DataFrame:
    """name, is_dir of the direct children, without the two dot entries; a name that is first seen (by file id) as a file stays one."""
    name, is_dir = direct_child(prefix, F.col("path"))
    c = files.select(name.alias("name"), is_dir.alias("is_dir"), "file_id").where("name <> ''")
    return c.groupBy("name").agg(F.min_by("is_dir", "file_id").alias("is_dir"))


def lookup(files: DataFrame, path: str) -> DataFrame:
    """kind: file for an exact path, directory for a prefix of one, nothing otherwise; an exact path wins."""
    p = F.col("path")
    hit = files.where((p == path) | p.startswith(path + "/")).agg(F.bool_or(p == path).alias("exact"))
    return hit.where("exact IS NOT NULL").select(F.when(F.col("exact"), "file").otherwise("directory").alias("kind"))


def validate_pool(known: DataFrame, found: DataFrame) -> DataFrame:
    """One row: status, missing, duplicates of the known disks against the discovered ones (once each)."""
    missing = known.join(found, "disk_id", "left_anti").agg(F.count("*").alias("missing"))
    twice = found.groupBy("disk_id").agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicates"))
    status = F.when(F.col("duplicates") > 0, "invalid").when(F.col("missing") > 0, "degraded").otherwise("healthy")
    return missing.join(twice, F.lit(True)).select(status.alias("status"), "missing", "duplicates")


# Fixed values of identity files.
LAYOUT_VERSION = 1
_IDENTITY = "pool_id bigint, disk_id bigint, role string, layout_version int"


def disk_identities(disks: DataFrame) -> DataFrame:
    """json: the identity file of each disk (pool_id, disk_id, role, layout_version)."""
    return disks.select(F.to_json(F.struct("pool_id", "disk_id", "role", "layout_version")).alias("json"))


def read_identities(texts: DataFrame) -> DataFrame:
    """pool_id, disk_id, role, error of identity files (json); one of another layout is refused."""
    i = texts.select(F.from_json("json", _IDENTITY).alias("i")).select("i.*")
    error = F.when(F.col("disk_id").isNull(), "unmarshal identity").when(F.coalesce("layout_version", F.lit(0)) != LAYOUT_VERSION, "incompatible layout version")
    return i.select("pool_id", "disk_id", "role", error.alias("error"))


def assemble(expected: DataFrame, found: DataFrame) -> DataFrame:
    """pool_id, status, found, missing (ids in order) of pools from the disks (pool_id, disk_id) that they should have and those
    that were found: online with all, degraded without some, failed without any. A pool's disks are few."""
    seen = found.select("pool_id", "disk_id").distinct().withColumn("_seen", F.lit(True))
    d = expected.join(seen, ["pool_id", "disk_id"], "left").groupBy("pool_id").agg(F.count("_seen").alias("found"), F.sort_array(F.collect_list(F.when(F.col("_seen").isNull(), F.col("disk_id")))).alias("missing"))
    status = F.when(F.col("found") == 0, "failed").when(F.size("missing") > 0, "degraded").otherwise("online")
    return d.select("pool_id", status.alias("status"), "found", F.array_join(F.col("missing").cast("array<string>"), ",").alias("missing"))
