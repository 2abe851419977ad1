"""Exact top-k inner-product search: tiles of queries by candidates, partial selection per tile, a tree of merges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, table

#: Vectors per tile side. Tiles bound a worker's memory; they don't change any result.
SHARD, BLOCK = 4096, 512
#: Lists merged at a time.
FAN_IN = 16
_EMPTY = np.iinfo(np.int64).min


def quantise(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) in the narrowest type that holds it; float64 beyond int64."""
    y = np.floor(x * scale)
    top = np.abs(y).max(initial=0)
    return y.astype("<i2" if top < 2**15 else "<i4" if top < 2**31 else "<i8" if top < 2**62 else "<f8")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products as int64: float64 BLAS while every sum stays below 2^53, else int64, else Python's integers.

    A product outside of int64 counts as the nearest int64 (the smallest is kept free as a mark).
    """
    bound = float(np.abs(a.astype("f8")).max(initial=0)) * float(np.abs(b.astype("f8")).max(initial=0)) * max(1, a.shape[1])
    if bound < 2**53:
        return (a.astype("f8") @ b.astype("f8").T).astype(np.int64)
    if bound < 2**63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a).dot(whole(b).T), _EMPTY + 1, 2**63 - 1).astype(np.int64)


def select(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k best scores (ties to the smaller id); ``ids`` ascend. Marked scores may be among them."""
    n = len(ids)
    if n <= k:
        return np.tile(np.arange(n), (len(scores), 1))
    if np.abs(np.where(scores == _EMPTY, 0, scores)).max(initial=0) < 2**61 // n:
        rank = np.where(scores == _EMPTY, _EMPTY, scores * n - np.arange(n))
        return np.argpartition(rank, n - k, axis=1)[:, n - k :]
    return np.array([np.lexsort((ids, ~s))[:k] for s in scores])


def _pack(batch: pa.Table, scale: float, key: str) -> pa.Table:
    ids = batch.column("vec_id").to_numpy()
    x = np.concatenate([np.zeros(0), *[c.values.to_numpy(zero_copy_only=False)[c.offsets[0].as_py() : c.offsets[-1].as_py()] for c in batch.column("x").chunks]])
    order = np.argsort(ids, kind="stable")
    y = quantise(x.reshape(len(ids), -1)[order], scale)
    return pa.table({"dim": pa.array([y.shape[1]], pa.int32()), key: batch.column(key)[:1].cast(pa.int64()), "ids": [ids[order].astype("<i8").tobytes()], "kind": [y.dtype.str], "m": [y.tobytes()]})


def _tiles(batches, k: int):
    """Partial lists of each row (a tile); tiles of one query block that follow each other are merged on the way."""
    held = None

    def out():
        _, part, qids, v, s = held
        rows = [[{"neg": -int(b), "vec_id": int(a)} for a, b in zip(*x) if b != _EMPTY] for x in zip(v, s)]
        return pa.RecordBatch.from_arrays([pa.array(qids), pa.array([part] * len(qids), pa.int64()), pa.array(rows, pa.list_(pa.struct([("neg", pa.int64()), ("vec_id", pa.int64())])))], ["query_id", "part", "top"])

    for batch in batches:
        for row in batch.to_pylist():
            d = row["dim"]
            qids, ids = (np.frombuffer(row[c], "<i8") for c in ("q_ids", "ids"))
            s = products(np.frombuffer(row["q_m"], row["q_kind"]).reshape(len(qids), d), np.frombuffer(row["m"], row["kind"]).reshape(len(ids), d))
            s[qids[:, None] == ids[None, :]] = _EMPTY
            at = select(s, ids, k)
            v, s = ids[at], np.take_along_axis(s, at, 1)
            key = (d, row["block"], row["g"])
            if held and held[0] != key:
                yield out()
                held = None
            if held:
                v, s = np.hstack([held[3], v]), np.hstack([held[4], s])
                best = np.lexsort((v, ~s), axis=1)[:, :k]
                v, s = np.take_along_axis(v, best, 1), np.take_along_axis(s, best, 1)
            held = (key, row["g"], qids, v, s)
    if held:
        yield out()


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``is_query`` the k rows of highest inner product of floor(scale * x).

    Ties go to the smaller id; a query is no candidate of itself; with fewer candidates all are returned. Rows with a null
    id and vectors that are null or hold null or non-finite components take no part; vectors meet only those of their own
    length (empty ones score 0). Repeats of the same id and vector count once; an id with two different vectors stands for
    two candidates, and its query keeps the better scores. Other columns are not read. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x"), is_query.alias("asks"))
    # Copies meet in the partial aggregation, before the shuffle.
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & finite).dropDuplicates(["vec_id", "x"])
    rows = scratch.save(rows.withColumn("dim", F.size("x")), "rows")
    n, asked = rows.agg(F.count("*"), F.count_if("asks")).first()
    spread = F.xxhash64("vec_id", "x")

    def packed(df: DataFrame, per: int, total: int, key: str) -> DataFrame:
        groups = df.withColumn(key, F.pmod(spread, F.lit(max(1, -(-total // per)))))
        return groups.select("dim", key, "vec_id", "x").groupBy("dim", key).applyInArrow(lambda t: _pack(t, scale, key), f"dim int, {key} long, ids binary, kind string, m binary")

    lanes = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // SHARD)))
    shards = packed(rows, SHARD, n, "shard").withColumn("g", F.col("shard") % lanes)
    blocks = packed(rows.where("asks"), BLOCK, asked, "block").select("dim", "block", F.col("ids").alias("q_ids"), F.col("kind").alias("q_kind"), F.col("m").alias("q_m"))
    # Each lane of shards gets all query blocks: a search of stated queries against all rows, block by block.
    blocks = blocks.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).withColumn("g", F.col("g").cast("long"))
    tiles = blocks.join(shards, ["dim", "g"])
    top = scratch.save(tiles.mapInArrow(lambda b: _tiles(b, k), "query_id long, part long, top array<struct<neg:long,vec_id:long>>"), "top", batch_rows=8)
    while True:
        top = top.groupBy("query_id", F.floor(F.col("part") / FAN_IN).alias("part")).agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("top")))), 1, k).alias("top"))
        if lanes <= 1:
            break
        lanes = -(-lanes // FAN_IN)
    top = top.select("query_id", F.posexplode("top").alias("rank", "best"))
    return top.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("best.vec_id").alias("vec_id"), (-F.col("best.neg")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
      FROM v AS a JOIN v AS b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
