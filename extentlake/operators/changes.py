"""Requests that change the catalog, many at a time: what each one's error is, and the rows that the others add or replace.

A batch's requests are judged against the catalog as it was, by joins on paths. ``files``: file_id, path, size_bytes, file_type,
mode, and whatever else the caller keeps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import FILE_TYPES, file_type
from .blobs_io import Blobs, with_content

#: Records of a write, a change of bytes, and a change of names.
WRITE_RECORDS = "prepared>data-written>parity-written>metadata-written>committed"
OVERWRITE_RECORDS = "prepared>data-written>parity-written>committed"
PERMISSIONS = 0o7777
FILE_KINDS = {name: bits for bits, name in FILE_TYPES}


def with_target(requests: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """The requests with ``file``: the catalog's row of their path, or null. Paths are unique in a catalog."""
    rows = files.select(F.col("path").alias("_path"), F.struct(*files.columns).alias("file"))
    return requests.join(rows, F.col(path) == F.col("_path"), "left").drop("_path")


def exists_error(file: Column) -> Column:
    return F.when(file.isNotNull(), "file already exists")


def creations(requests: DataFrame, files: DataFrame) -> DataFrame:
    """request, error, file_type, mode, size_bytes of requests (request, path, kind, mode, target) to make a directory, a symbolic
    link or a special file. The mode's permissions are kept; a special file's mode has its type as well."""
    r = with_target(requests, files)
    special = file_type(F.col("mode"))
    error = (
        F.when(F.col("path") == "", "path required").when(F.col("file").isNotNull(), "file already exists")
        .when((F.col("kind") == "special") & ~special.isin("fifo", "socket", "block", "char"), "not a special file")
    )
    mode = F.when(F.col("kind") == "special", F.col("mode")).otherwise(F.col("mode").bitwiseAND(PERMISSIONS))
    kind = F.when(F.col("kind") == "special", special).otherwise(F.col("kind"))
    ok = error.isNull()
    size = F.when(F.col("kind") == "symlink", F.octet_length("target")).otherwise(0).cast("long")
    return r.select("request", error.alias("error"), *[F.when(ok, v).alias(n) for n, v in (("file_type", kind), ("mode", mode), ("size_bytes", size))])


def hard_links(requests: DataFrame, files: DataFrame) -> DataFrame:
    """request, error, file_id of requests (request, path, new_path): the link has its source's file id, so its extents."""
    r = with_target(with_target(requests, files).withColumnRenamed("file", "source"), files, "new_path")
    error = (
        F.when((F.col("path") == "") | (F.col("new_path") == ""), "paths required").when(F.col("source").isNull(), "file not found")
        .when(F.col("source.file_type") == "directory", "cannot link directories").when(F.col("file").isNotNull(), "file already exists")
    )
    return r.select("request", error.alias("error"), F.when(error.isNull(), F.col("source.file_id")).alias("file_id"))


def ancestors(path: Column) -> Column:
    """All directories above a path, of paths of bounded depth."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def removals(requests: DataFrame, files: DataFrame) -> DataFrame:
    """request, error of requests (request, path) to remove directories: only empty ones go. What lies below a directory is found
    by a join on all ancestors of all paths, counted before the shuffle."""
    below = files.select(F.explode(ancestors(F.col("path"))).alias("_dir")).groupBy("_dir").agg(F.count("*").alias("_n"))
    r = with_target(requests, files).join(below, F.col("path") == F.col("_dir"), "left")
    error = (
        F.when(F.col("path") == "", "path required").when(F.col("file").isNull(), "file not found").when(F.col("file.file_type") != "directory", "not a directory")
        .when(F.col("_n").isNotNull(), "directory not empty")
    )
    return r.select("request", error.alias("error"))


def renames(requests: DataFrame, files: DataFrame) -> DataFrame:
    """request, error, path of requests (request, path, new_path) to rename one file; the same path twice changes nothing."""
    r = with_target(with_target(requests, files).withColumnRenamed("file", "source"), files, "new_path")
    error = (
        F.when((F.col("path") == "") | (F.col("new_path") == ""), "paths required").when(F.col("source").isNull(), "file not found")
        .when((F.col("path") != F.col("new_path")) & F.col("file").isNotNull(), "destination exists")
    )
    return r.select("request", error.alias("error"), F.when(error.isNull(), F.col("new_path")).otherwise(F.when(F.col("source").isNotNull(), F.col("path"))).alias("path"))


def attribute_changes(requests: DataFrame, files: DataFrame) -> DataFrame:
    """request, error, file_id, mode, mtime after requests (request, path, mode, mtime): null leaves a value as it is."""
    r = with_target(requests, files)
    error = F.when(F.col("path") == "", "path required").when(F.col("file").isNull(), "file not found")
    ok = error.isNull()
    mode, mtime = F.coalesce(r["mode"].bitwiseAND(PERMISSIONS), F.col("file.mode")), F.coalesce(r["mtime"], F.col("file.mtime"))
    return r.select("request", error.alias("error"), F.when(ok, F.col("file.file_id")).alias("file_id"), F.when(ok, mode).alias("mode"), F.when(ok, mtime).alias("mtime"))


def writes(requests: DataFrame, files: DataFrame, extent_size: int, width: int, replace: bool = False) -> DataFrame:
    """request, error, replaced, extents, groups, records of requests (request, path, size) to write new files; with ``replace`` an
    existing one is deleted before. The extents themselves are ``placement.split_files`` of the requests without an error."""
    r = with_target(requests, files)
    error = F.when(F.col("path") == "", "path required").when(F.col("size") < 0, "negative size")
    if not replace:
        error = error.when(F.col("file").isNotNull(), "file already exists")
    ok = error.isNull()
    n = F.ceil(F.col("size") / extent_size).cast("long")
    return r.select(
        "request", error.alias("error"), (ok & F.col("file").isNotNull()).alias("replaced"), F.when(ok, n).alias("extents"),
        F.when(ok, F.ceil(n / width).cast("long")).alias("groups"), F.when(ok, WRITE_RECORDS).alias("records"),
    )


def overlay(content: Column, data: Column, at: Column) -> Column:
    """``content`` with ``data`` over its bytes from ``at`` on; the length stays."""
    at, n = at.cast("int"), F.octet_length(data)
    return F.concat(F.substr(content, F.lit(1), at), data, F.substr(content, at + n + 1, F.octet_length(content)))


def overwrite_errors(requests: DataFrame, files: DataFrame, extents: DataFrame) -> DataFrame:
    """The requests (request, path, offset, data) with error, file_id."""
    r = with_target(requests, files)
    known = extents.select("file_id").distinct().withColumn("_has", F.lit(True))
    r = r.withColumn("file_id", F.col("file.file_id")).join(known, "file_id", "left")
    error = (
        F.when(F.octet_length("data") == 0, "empty payload").when(F.col("offset") < 0, "invalid offset").when(F.col("file").isNull(), "file not found")
        .when(F.col("_has").isNull(), "no extents").when(F.col("offset") + F.octet_length("data") > F.col("file.size_bytes"), "beyond the end")
    )
    return r.select("request", "file_id", "offset", "data", error.alias("error"))


def overwritten(judged: DataFrame, extents: DataFrame, blobs: Blobs) -> DataFrame:
    """request, extent_no, pg, content of the extents that valid requests touch, with the new bytes; others aren't read. One request a file: those of
    one batch don't build on each other."""
    r = judged.where("error IS NULL").withColumn("_end", F.col("offset") + F.octet_length("data"))
    x = r.join(extents.select("file_id", "extent_no", "pg", "logical_offset", "length"), "file_id")
    stop = F.col("logical_offset") + F.col("length")
    x = with_content(x.where((F.col("logical_offset") < F.col("_end")) & (stop > F.col("offset"))), blobs).where("content IS NOT NULL")
    start = F.greatest("offset", "logical_offset")
    piece = F.substr(F.col("data"), (start - F.col("offset") + 1).cast("int"), (F.least("_end", stop) - start).cast("int"))
    return x.select("request", "extent_no", "pg", overlay(F.col("content"), piece, start - F.col("logical_offset")).alias("content"))


def attributes(files: DataFrame, uid: int, gid: int, now: Column) -> DataFrame:
    """file_id, size, mode, nlink, uid, gid, atime, mtime, ctime as a file system shows them; unset times are now or the mtime."""
    mtime = F.when(F.coalesce("mtime", F.lit(0)) == 0, now).otherwise(F.col("mtime"))
    ctime = F.when(F.coalesce("ctime", F.lit(0)) == 0, mtime).otherwise(F.col("ctime"))
    return files.select("file_id", F.col("size_bytes").alias("size"), mode_of(F.col("file_type"), F.col("mode")).alias("mode"), F.lit(1).alias("nlink"), F.lit(uid).alias("uid"), F.lit(gid).alias("gid"), mtime.alias("atime"), mtime.alias("mtime"), ctime.alias("ctime"))


def mode_of(kind: Column, mode: Column) -> Column:
    """Type and permissions: fixed ones for all but regular files, whose own permissions count if there are any."""
    out = F.when(F.lit(False), F.lit(0))
    for name, code in FILE_KINDS.items():
        out = out.when(kind == name, code | {"symlink": 0o777, "directory": 0o755}.get(name, 0o644))
    own = F.when(mode.bitwiseAND(0o170000) == 0, 0o100000).otherwise(mode.bitwiseAND(0o170000)).bitwiseOR(mode.bitwiseAND(0o777))
    return out.when(F.coalesce(mode, F.lit(0)) == 0, 0o100644).otherwise(own).cast("long")
