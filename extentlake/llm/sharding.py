"""Reproducible sharding: a Feistel permutation with cycle walking over global row numbers.

Row numbers come from a fixed order, so position, shard and slot of a row can be computed, and inverted, from its number,
the number of rows and the seed alone: position = permute(number), shard = position mod shards, slot = position div shards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from ._common import Scratch, table

#: Rows are numbered inside this many fixed buckets, then the buckets' totals are summed; part of the numbering's law.
BUCKETS = 4096
#: Repeats of one row are unrolled in pieces of this many.
CHUNK = 4096
ROUNDS = 6


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Feistel:
    """A permutation of 0..n-1: an unbalanced Feistel network on the next power of two, walked until it falls inside."""

    def __init__(self, n: int, seed: int):
        self.n, bits = n, max(2, (max(n, 1) - 1).bit_length())
        self.lo, self.hi = np.uint64(bits // 2), np.uint64(bits - bits // 2)
        with np.errstate(over="ignore"):
            self.keys = _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed % 2**64))

    def _round(self, x, key, bits):
        with np.errstate(over="ignore"):
            return _mix(x + key) & ((np.uint64(1) << bits) - np.uint64(1))

    def _once(self, x, back=False):
        lo, hi = self.lo, self.hi
        left, right = x >> lo, x & ((np.uint64(1) << lo) - np.uint64(1))
        for k in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            if k % 2 == 0:
                left = left ^ self._round(right, self.keys[k], hi)
            else:
                right = right ^ self._round(left, self.keys[k], lo)
        return left << lo | right

    def _walk(self, x, back):
        out = self._once(np.asarray(x).astype(np.uint64), back)
        while (far := np.flatnonzero(out >= np.uint64(self.n))).size:
            out[far] = self._once(out[far], back)
        return out.astype(np.int64)

    def permute(self, x) -> np.ndarray:
        return self._walk(x, False)

    def invert(self, y) -> np.ndarray:
        return self._walk(y, True)


def number_rows(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """Global row numbers 0..n-1 in a fixed order of ``keys`` (hash bucket, then keys); equal rows get neighbouring numbers.

    Equal rows are counted before the shuffle and unrolled after it, so that no group of copies meets in one task.
    """
    spark = rows.sparkSession
    groups = rows.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)))
    groups = Scratch(spark, "sharding").save(groups, "groups")
    totals = groups.groupBy("_b").agg(F.sum("_n").alias("_t"))
    total = totals.agg(F.sum("_t")).first()[0] or 0
    # At most BUCKETS rows, by construction.
    offsets = totals.select("_b", F.coalesce(F.sum("_t").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    before = W.partitionBy("_b").orderBy(*[F.asc_nulls_first(k) for k in keys]).rowsBetween(W.unboundedPreceding, -1)
    placed = groups.withColumn("_s", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(F.broadcast(offsets), "_b").withColumn("_s", F.col("_s") + F.col("_o"))
    unroll = lambda df: df.select(*keys, F.explode(F.sequence(F.col("_s"), F.col("_s") + F.col("_n") - 1)).alias("row_no"))
    many = placed.where(F.col("_n") > CHUNK).select(*keys, F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / CHUNK))).alias("_c"), "_s", "_n")
    many = many.withColumn("_s", F.col("_s") + F.col("_c") * CHUNK).withColumn("_n", F.least(F.lit(CHUNK), F.col("_n") - F.col("_c") * CHUNK)).repartition("_s")
    return unroll(placed.where(F.col("_n") <= CHUNK)).unionByName(unroll(many)), total


def shard(documents: DataFrame, shards: int = 40, seed: int = 20240229, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, bytes, text_crc32, law, shard, slot, grown_shard, row_no, position of every row.

    Law ``rows``: counts of any two shards differ by at most one, and slots are gapless from 0. A null text has no bytes:
    size 16, checksum 0, like an empty one. Null ids, ties and repeated rows each get a place of their own; other columns
    are not read; an empty table gives an empty result. ``grown_shard`` belongs to another law and is null.
    """
    text = F.col(text_col)
    rows = documents.select(
        F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16).alias("bytes"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), F.xxhash64(text).alias("text_hash"),
    )
    numbered, n = number_rows(rows, ["doc_id", "bytes", "text_crc32", "text_hash"])
    law = Feistel(n, seed)

    @F.pandas_udf("long")
    def position(x: pd.Series) -> pd.Series:
        return pd.Series(law.permute(x.to_numpy()))

    out = numbered.withColumn("position", position("row_no"))
    return out.select(
        "doc_id", "bytes", "text_crc32", F.lit("rows").alias("law"), F.pmod("position", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("position") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_no", "position",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
