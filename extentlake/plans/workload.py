"""Deterministic projections of the driver's tables into the pool model, as DataFrames and as SQL text.

Integer arithmetic only, so that both engines agree. A query names the tables that it uses; ``sql`` puts their common
table expressions in front.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import STATES
from ..sources.tables import shared_path

_LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
#: 32-bit words of an extent's content: 1 to LANES.
LANES = 8


class Pool:
    """The model's tables over one directory of Parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._stored = spark, sf_dir, {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def extents(self) -> DataFrame:
        by = W.partitionBy("l_orderkey").orderBy(*_LINE)
        length = F.col("l_quantity").cast("long") * 4096
        x = self.table("lineitem").select("l_orderkey", *_LINE).withColumn("n", F.row_number().over(by).cast("long")).withColumn("length", length)
        offset = F.coalesce(F.sum("length").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        return x.select(
            (F.col("l_orderkey") * 1000 + F.col("n")).alias("extent_no"), F.col("l_orderkey").alias("file_id"), "n", "length", offset.alias("logical_offset"),
            F.col("l_suppkey").alias("data_disk"), (F.col("l_partkey") % 10).alias("mirror_disk"), (F.col("l_orderkey") * 1000 + F.floor((F.col("n") - 1) / 3)).alias("pg"),
        )

    def stored(self, name: str, df: DataFrame) -> DataFrame:
        """``df``, written once for a query that reads it many times."""
        if name not in self._stored:
            path = shared_path(self.spark, name)
            df.write.parquet(path)
            self._stored[name] = self.spark.read.parquet(path)
        return self._stored[name]

    def stored_extents(self) -> DataFrame:
        return self.stored("extents", self.extents())

    def files(self) -> DataFrame:
        path = F.concat(F.lit("/shares/"), F.lower("o_orderstatus"), F.lit("/c"), "o_custkey", F.lit("/o"), "o_orderkey", F.lit(".bin"))
        return self.table("orders").select(F.col("o_orderkey").alias("file_id"), path.alias("path"), F.col("o_orderdate").alias("mtime"))

    def disks(self) -> DataFrame:
        s = F.col("s_suppkey")
        capacity = (s + 1000) * 1048576
        return self.table("supplier").select(
            s.alias("disk_id"), F.when(s % 10 == 0, "parity").when(s % 10 == 9, "metadata").otherwise("data").alias("role"),
            F.when(s % 11 == 0, "failed").when(s % 7 == 0, "degraded").otherwise("online").alias("health"), capacity.alias("capacity"),
            (F.floor(capacity / 5) * (s % 5)).alias("free"),
        )

    def groups(self) -> DataFrame:
        return self.extents().groupBy("pg").agg(F.count("*").alias("members"), F.min("file_id").alias("file_id")).withColumn("parity_disk", F.col("pg") % 10 * 10)

    def journal(self) -> DataFrame:
        """tx, seq, state, repair: the states that an order's status stands for, with an injected gap at every 53rd order."""
        o = self.table("orders").select(F.col("o_orderkey").alias("tx"), "o_orderstatus")
        reach = F.when(F.col("o_orderstatus") == "F", 5).when(F.col("o_orderstatus") == "O", 1 + F.col("tx") % 4).otherwise(1)
        states = F.array(*[F.lit(s) for s in STATES[:5]])
        done = o.select("tx", "o_orderstatus", F.posexplode(F.slice(states, F.lit(1), reach.cast("int"))).alias("i", "state"))
        done = done.where(~((F.col("i") == 1) & (F.col("tx") % 53 == 0))).select("tx", (F.col("tx") * 10 + F.col("i") + 1).alias("seq"), "state")
        aborted = o.where("o_orderstatus = 'P'").select("tx", (F.col("tx") * 10 + 9).alias("seq"), F.lit("aborted").alias("state"))
        stuck = o.where("o_orderstatus = 'O' AND tx % 5 = 0").select("tx", (F.col("tx") * 10 + 8).alias("seq"), F.lit("replay-required").alias("state"))
        return done.unionByName(aborted).unionByName(stuck).withColumn("repair", F.col("tx") % 59 == 0)

    def lanes(self, extents: DataFrame | None = None) -> DataFrame:
        """extent_no, pg, length, lane, word: contents as 32-bit words (from a digest), zero beyond an extent's own length."""
        x = (self.extents() if extents is None else extents).select("extent_no", "pg", "data_disk", "length", F.sha2(F.col("extent_no").cast("string"), 256).alias("h"))
        words = F.transform(F.sequence(F.lit(0), (F.col("length") / 4096 % LANES).cast("int")), lambda j: F.conv(F.substr(F.col("h"), j * 8 + 1, F.lit(8)), 16, 10).cast("long"))
        return x.select("extent_no", "pg", "data_disk", "length", F.posexplode(words).alias("lane", "word"))

    def samples(self) -> DataFrame:
        """Latency samples in whole microseconds."""
        return self.table("events").select("event_id", "ts", F.col("user_id").alias("disk"), "event_type", F.floor(F.abs(F.col("value")) * 1000).cast("long").alias("micros"))


_CTE = {
    "ext": f"""ext AS (SELECT l_orderkey * 1000 + n AS extent_no, l_orderkey AS file_id, n, length,
        CAST(coalesce(sum(length) OVER (PARTITION BY l_orderkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS logical_offset,
        l_suppkey AS data_disk, l_partkey % 10 AS mirror_disk, l_orderkey * 1000 + (n - 1) // 3 AS pg
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_LINE)}) AS n, CAST(l_quantity AS BIGINT) * 4096 AS length FROM lineitem))""",
    "files": "files AS (SELECT o_orderkey AS file_id, '/shares/' || lower(o_orderstatus) || '/c' || o_custkey || '/o' || o_orderkey || '.bin' AS path, o_orderdate AS mtime FROM orders)",
    "disks": """disks AS (SELECT s_suppkey AS disk_id, CASE WHEN s_suppkey % 10 = 0 THEN 'parity' WHEN s_suppkey % 10 = 9 THEN 'metadata' ELSE 'data' END AS role,
        CASE WHEN s_suppkey % 11 = 0 THEN 'failed' WHEN s_suppkey % 7 = 0 THEN 'degraded' ELSE 'online' END AS health,
        1048576 * (1000 + s_suppkey) AS capacity, 1048576 * (1000 + s_suppkey) // 5 * (s_suppkey % 5) AS free FROM supplier)""",
    "groups": "groups AS (SELECT pg, count(*) AS members, min(file_id) AS file_id, pg % 10 * 10 AS parity_disk FROM ext GROUP BY pg)",
    "journal": """journal AS (
        SELECT o_orderkey AS tx, o_orderkey * 10 + i AS seq, state, o_orderkey % 59 = 0 AS repair FROM orders
          JOIN (VALUES (1, 'prepared'), (2, 'data-written'), (3, 'parity-written'), (4, 'metadata-written'), (5, 'committed')) AS s(i, state)
          ON i <= CASE o_orderstatus WHEN 'F' THEN 5 WHEN 'O' THEN 1 + o_orderkey % 4 ELSE 1 END WHERE NOT (i = 2 AND o_orderkey % 53 = 0)
        UNION ALL SELECT o_orderkey, o_orderkey * 10 + 9, 'aborted', o_orderkey % 59 = 0 FROM orders WHERE o_orderstatus = 'P'
        UNION ALL SELECT o_orderkey, o_orderkey * 10 + 8, 'replay-required', o_orderkey % 59 = 0 FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 5 = 0)""",
    "lanes": """lanes AS (SELECT extent_no, pg, data_disk, length, CAST(j AS INTEGER) AS lane, CAST('0x' || substr(sha256(CAST(extent_no AS VARCHAR)), 8 * j + 1, 8) AS BIGINT) AS word
        FROM ext, unnest(range(length // 4096 % 8 + 1)) AS u(j))""",
    "samples": "samples AS (SELECT event_id, ts, user_id AS disk, event_type, CAST(floor(abs(value) * 1000) AS BIGINT) AS micros FROM events)",
}


def sql(tables: str, body: str) -> str:
    """``body`` (more common table expressions may stand before its SELECT, split off by a line ``--``) over model tables."""
    more, _, main = body.rpartition("\n--\n")
    head = [*(_CTE[t] for t in tables.split()), *([more] if more else [])]
    # A recursive expression says so at its beginning; the word belongs to the whole list.
    recursive = more.startswith("RECURSIVE ")
    head = [h.removeprefix("RECURSIVE ") for h in head]
    return ("WITH " + "RECURSIVE " * recursive + ",\n".join(head) + "\n" if head else "") + main
