"""Sorted 64-bit keys in compact binary blocks, dealt into buckets by their leading bits.

Counting billions of hashes as single rows would cost several times their size in row headers. A map task instead sorts
a bounded chunk of keys and sends one block per bucket: the keys as differences of six bytes, and any columns beside them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
#: Bytes of text whose keys make one bucket; a bucket is loaded by one call.
BUCKET_TEXT_BYTES = 4 << 20
#: Map tasks deal into at most so many buckets at once; beyond, a second shuffle splits each into the final ones.
FIRST_BUCKETS = 4096


def bucket_count(texts: DataFrame, column: str = "text") -> int:
    """By the texts' bytes, so that a bucket doesn't grow with the data; at least two per shuffle partition, so that hashing
    buckets to partitions stays even."""
    size = texts.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0
    return max(2 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_TEXT_BYTES))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key; ascending keys have ascending buckets."""
    return ((keys >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def dealt(blocks: DataFrame, buckets: int, resplit) -> DataFrame:
    """``blocks`` in their final buckets. Map tasks deal into ``first_buckets``; where that is fewer, ``resplit`` gets each
    first bucket's blocks as a stream, in bounded chunks, and deals them once more."""
    if buckets <= FIRST_BUCKETS:
        return blocks
    return blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(resplit, blocks.schema)


def first_buckets(buckets: int) -> int:
    return min(buckets, FIRST_BUCKETS)


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending uint64 keys: the first one, then differences of six bytes (of eight, if one needs them)."""
    if not len(keys):
        return b""
    gaps = np.diff(keys)
    wide = bool(len(gaps)) and int(gaps.max()) >= 1 << 48
    raw = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)
    return bytes([wide]) + keys[:1].astype("<u8").tobytes() + (raw if wide else raw[:, :6]).tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, U)
    raw = np.frombuffer(data, np.uint8, offset=9).reshape(-1, 8 if data[0] else 6)
    gaps = np.zeros((len(raw), 8), np.uint8)
    gaps[:, : raw.shape[1]] = raw
    out = np.empty(len(raw) + 1, U)
    out[0] = np.frombuffer(data, "<u8", 1, 1)[0]
    out[1:] = gaps.view("<u8").ravel()
    with np.errstate(over="ignore"):
        return np.cumsum(out, dtype=U)


def cuts(keys: np.ndarray, buckets: int) -> list[tuple[int, slice]]:
    """(bucket, place) of the buckets that ascending keys fall into."""
    b = bucket_of(keys, buckets)
    at = runs(b)
    return [(int(b[s]), slice(s, e)) for s, e in zip(at[:-1], at[1:])]


def runs(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the end."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)
