"""Catalog changes as (state, arguments) -> state' or its difference; and file reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def file_extents(files: DataFrame, extents: DataFrame, path: str) -> DataFrame:
    """The extents of one path, by offset; the filter reaches both scans."""
    return extents_of(files.where(F.col("path") == path), extents)


def extents_of(files: DataFrame, extents: DataFrame) -> DataFrame:
    one = files.select("file_id", "path")
    return one.join(extents, "file_id").select("path", "extent_no", "logical_offset", "length").orderBy("logical_offset")


def overlapping(extents: DataFrame, start: Column, end: Column) -> DataFrame:
    """Extents that meet the half-open range [start, end), with what they share with it."""
    stop = F.col("logical_offset") + F.col("length")
    x = extents.where((F.col("logical_offset") < end) & (stop > start))
    first = F.greatest(F.col("logical_offset"), start)
    return x.select("file_id", "extent_no", first.alias("overlap_start"), (F.least(stop, end) - first).alias("overlap_len"))


def truncated(extents: DataFrame, new_size: Column) -> DataFrame:
    """Extents that a truncation removes: all that reach beyond the new size, the one at the boundary whole."""
    return extents.where(F.col("logical_offset") + F.col("length") > new_size)


def release(disks: DataFrame, removed: DataFrame) -> DataFrame:
    """disk_id, removed, freed, free after the extents are gone, for every disk."""
    r = removed.groupBy(F.col("data_disk").alias("disk_id")).agg(F.count("*").alias("removed"), F.sum("length").alias("freed"))
    return disks.select("disk_id", "free").join(r, "disk_id", "left").na.fill(0, ["removed", "freed"]).withColumn("free", F.col("free") + F.col("freed"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key; ``source`` says where a row came from."""
    values = [c for c in old.columns if c != key]
    o, n = old.select(key, F.struct(*values).alias("o")), new.select(key, F.struct(*values).alias("n"))
    both = o.join(n, key, "full_outer")
    source = F.when(F.col("o").isNull(), "inserted").when(F.col("n").isNull(), "kept").otherwise("updated")
    return both.select(key, F.coalesce("n", "o").alias("v"), source.alias("source")).select(key, "v.*", "source")


def merge_members(old: DataFrame, new: DataFrame) -> DataFrame:
    """pg, members: old members first, then new ones, each once (groups are bounded by their width)."""
    both = old.select("pg", F.col("members").alias("o")).join(new.select("pg", F.col("members").alias("n")), "pg", "full_outer")
    none = F.array().cast("array<bigint>")
    return both.select("pg", F.array_union(F.coalesce("o", none), F.coalesce("n", none)).alias("members"))


def changed_members(before: DataFrame, after: DataFrame) -> DataFrame:
    """Groups whose set of members differs; a group on one side only has changed."""
    norm = lambda c: F.array_sort(F.array_distinct(c))
    both = before.select("pg", norm(F.col("members")).alias("b")).join(after.select("pg", norm(F.col("members")).alias("a")), "pg", "full_outer")
    return both.select("pg", (~F.col("a").eqNullSafe(F.col("b"))).alias("changed"))


def renamed(files: DataFrame, old: str, new: str) -> DataFrame:
    """Rename a file, or a directory with all below it."""
    p = F.col("path")
    return files.withColumn("path", F.when(p == old, new).when(p.startswith(old + "/"), F.concat(F.lit(new), F.substring(p, len(old) + 1, 2**31 - 1))).otherwise(p))


def assembled(parts: DataFrame) -> DataFrame:
    """file_id, size, digest of the concatenation of extents' contents by offset (a file's row is one value)."""
    p = F.array_sort(F.collect_list(F.struct("logical_offset", "content")))
    return parts.groupBy("file_id").agg(F.array_join(p.getField("content"), "").alias("content")).select("file_id", F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("digest"))


def on_disk(extents: DataFrame, disk_id: int) -> DataFrame:
    """Extents with data or a mirror on a disk."""
    return extents.where((F.col("data_disk") == disk_id) | (F.col("mirror_disk") == disk_id))


def without_extents(groups: DataFrame, removed: DataFrame) -> DataFrame:
    """pg, members without the removed extents, freed bytes; a group that loses all stays, empty."""
    r = removed.groupBy("pg").agg(F.collect_list("extent_no").alias("_gone"), F.sum("length").alias("freed"))
    g = groups.join(r, "pg", "left")
    return g.select("pg", F.array_except("members", F.coalesce("_gone", F.array().cast("array<bigint>"))).alias("members"), F.coalesce("freed", F.lit(0).cast("long")).alias("freed"))


def exclusions(disks: DataFrame, health: DataFrame, extents: DataFrame) -> DataFrame:
    """disk_id, to_move: data disks that the health checks left failing, and how many extents have data or a mirror there."""
    out = disks.where("role = 'data'").select("disk_id").join(health.where("final_state = 'failing'").select(F.col("disk").alias("disk_id")), "disk_id", "left_semi")
    places = extents.select(F.explode(F.array_distinct(F.array("data_disk", "mirror_disk"))).alias("disk_id")).groupBy("disk_id").agg(F.count("*").alias("to_move"))
    return out.join(places, "disk_id", "left").na.fill(0, ["to_move"])
