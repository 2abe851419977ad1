"""Placement of extents on disks and in parity groups."""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_files(files: DataFrame, extent_size: int, width: int) -> DataFrame:
    """file_id, n, offset, length, pg_no: files cut into extents of one size; the last takes the rest; none for size 0."""
    last = F.ceil(F.col("size") / extent_size)
    x = files.where("size > 0").select("file_id", "size", F.explode(F.sequence(F.lit(1), last.cast("long"))).alias("n"))
    offset = (F.col("n") - 1) * extent_size
    return x.select("file_id", "n", offset.alias("offset"), F.least(F.lit(extent_size), F.col("size") - offset).alias("length"), (F.floor((F.col("n") - 1) / width) + 1).alias("pg_no"))


def append_extents(files: DataFrame, extent_size: int, n_disks: int) -> DataFrame:
    """Appends: file_id, number, disk_idx, pg_no, path from the extent number alone (group width 3, disk = number mod disks)."""
    n = F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("append") / extent_size).cast("long")))
    x = files.where("append > 0").select("file_id", "existing", n.alias("k")).withColumn("number", F.col("existing") + F.col("k"))
    two = lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))
    path = F.concat(F.lit("data/"), two(F.floor(F.col("number") / 256) % 256), F.lit("/"), two(F.col("number") % 256), F.lit("/"), F.format_string("extent-%06d.bin", "number"))
    return x.select("file_id", "number", (F.col("number") % n_disks).alias("disk_idx"), (F.floor((F.col("number") - 1) / 3) + 1).alias("pg_no"), path.alias("path"))


def place_greedily(disks: list[tuple[int, int, int]], wanted: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(extent, disk) in order: of the disks with room (those not yet in the group first) the one with the fewest extents,
    most free bytes, smallest id. disks: (id, extents, free); wanted: (extent, group, length)."""
    state, groups, out = {d: [n, free] for d, n, free in disks}, {}, []
    for extent, group, length in wanted:
        ready = [d for d, (_, free) in state.items() if free > 0]
        fresh = [d for d in ready if d not in groups.setdefault(group, set())] or ready
        if not fresh:
            raise ValueError(f"no disk has room for extent {extent}")
        d = min(fresh, key=lambda d: (state[d][0], -state[d][1], d))
        if state[d][1] < length:
            raise ValueError(f"disk {d} has no room for extent {extent}")
        state[d][0] += 1
        state[d][1] -= length
        groups[group].add(d)
        out.append((extent, d))
    return out


def greedy_placement(extents: DataFrame, disks: DataFrame, key: str = "file_id") -> DataFrame:
    """extent_no, disk_id: every file placed against the same free disks. The choice depends on the file's earlier extents,
    so it is a fold per file; files are independent requests. A disk without extents comes before all others and is in no
    group yet, so a file of n extents uses the first n disks by free bytes and id at most, and no other disk is kept. Files
    stream through each partition in order, many to a batch.
    """
    most = extents.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    eligible = disks.where("role = 'data' AND lower(health) = 'online' AND free > 0").select("disk_id", "free")
    ready = [(r.disk_id, 0, r.free) for r in eligible.orderBy(F.desc("free"), "disk_id").limit(most).collect()]

    def placed(rows: list[tuple]) -> list[tuple[int, int]]:
        return place_greedily(ready[: len(rows)], [r[1:] for r in rows])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            out = []
            for _, more in groupby(zip(*(c.to_pylist() for c in batch.columns)), itemgetter(0)):
                more = list(more)
                # The last file of a batch may go on in the next one.
                if held and held[0][0] != more[0][0]:
                    out += placed(held)
                    held = []
                held += more
            yield _placed(out)
        if held:
            yield _placed(placed(held))

    # By a hash of the key, as in ``xor.xor_blobs``.
    x = extents.select(F.col(key).alias("key"), F.col("extent_no").cast("long"), "pg", "length").repartition(F.xxhash64("key"))
    return x.sortWithinPartitions("key", "extent_no", "pg", "length").mapInArrow(fold, "extent_no long, disk_id long")


def _placed(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e for e, _ in rows], pa.int64()), pa.array([d for _, d in rows], pa.int64())], ["extent_no", "disk_id"])


def least_loaded(disks: list[tuple[int, int, int]], lengths: Iterable[int]) -> Iterator[int | None]:
    """For each length in order the disk of the fewest extents, then most free bytes, smallest id, among those with
    ``free >= length``; None if there is none. A move raises its disk's count. disks: (id, extents, free)."""
    queue = [(n, -free, d) for d, n, free in disks]
    heapq.heapify(queue)
    for length in lengths:
        full = []
        while queue and -queue[0][1] < length:
            full.append(heapq.heappop(queue))
        if queue:
            n, free, d = queue[0]
            heapq.heapreplace(queue, (n + 1, free, d))
        yield d if queue else None
        for x in full:
            heapq.heappush(queue, x)


def relocate(extents: DataFrame, disks: DataFrame, excluded: int) -> DataFrame:
    """extent_no, new_disk of the excluded disk's extents: one after the other by extent_no to the least loaded online data
    disk with room (``least_loaded``); null where no disk has room. As in the reference, moves don't lower free bytes.

    Each choice depends on all before it, so the excluded disk's extents stream through one task in order; its state is one
    count a disk. The online data disks are a dimension of bounded size.
    """
    load = extents.groupBy(F.col("data_disk").alias("disk_id")).agg(F.count("*").alias("load"))
    ready = disks.where((F.col("role") == "data") & (F.col("health") == "online") & (F.col("disk_id") != excluded)).join(load, "disk_id", "left").na.fill(0, ["load"])
    ready = [(r.disk_id, r.load, r.free) for r in ready.select("disk_id", "load", "free").collect()]
    if not ready:
        raise ValueError("no online data disks remain")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes: deque[int] = deque()
        chosen = least_loaded(ready, iter(sizes.popleft, None))
        for batch in batches:
            sizes.extend(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([next(chosen) for _ in range(batch.num_rows)], pa.int64())], ["extent_no", "new_disk"])

    moved = extents.where(F.col("data_disk") == excluded).select(F.col("extent_no").cast("long"), "length")
    return moved.repartition(1).sortWithinPartitions("extent_no").mapInArrow(fold, "extent_no long, new_disk long")
