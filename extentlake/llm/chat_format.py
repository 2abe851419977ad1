"""Chat formatting with cumulative-snapshot collapse (DataFrame functions only).

Chat logs often hold a conversation again and again as it grows. Every turn gets a rolling hash of the turns up to it
(two 64-bit words, the exclusive-or of hashes that hold the turn's position); a conversation whose last hash is also the
hash of an earlier turn of a longer one is a snapshot, and an anti-join drops it. Of equal conversations the one with
the smallest id stays. What is left is rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from ._common import Scratch, table

#: Turn numbers per block: no window holds more of a long conversation than this many distinct turn numbers.
BLOCK = 256
#: Turns per rendered part.
PART = 64


def _turns(conversations: DataFrame) -> DataFrame:
    """Rows with their position in the conversation (1, 2, ...) and its length; sorted by turn, role, text, nulls first."""
    t = conversations.select("conv_id", "turn", "role", "text").where(F.col("conv_id").isNotNull())
    t = t.withColumn("block", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / BLOCK))
    inside = W.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    conv = W.partitionBy("conv_id")
    blocks = t.groupBy("conv_id", "block").agg(F.count("*").alias("n")).select(
        "conv_id", "block",
        F.coalesce(F.sum("n").over(conv.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("n").over(conv).alias("n_turns"),
    )
    return t.withColumn("k", F.row_number().over(inside)).join(blocks, ["conv_id", "block"]).withColumn("k", F.col("before") + F.col("k")).drop("before")


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """conv_id, k, n_turns and the hash (a, b) of the first k turns."""
    part = lambda salt: F.xxhash64(F.lit(salt), "k", F.col("role").isNull(), "role", F.col("text").isNull(), "text")
    t = _turns(conversations).select("conv_id", "block", "k", "n_turns", part(1).alias("ha"), part(2).alias("hb"))
    conv = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = t.groupBy("conv_id", "block").agg(F.bit_xor("ha").alias("xa"), F.bit_xor("hb").alias("xb")).select(
        "conv_id", "block", F.coalesce(F.bit_xor("xa").over(conv), F.lit(0)).alias("xa"), F.coalesce(F.bit_xor("xb").over(conv), F.lit(0)).alias("xb"),
    )
    run = W.partitionBy("conv_id", "block").orderBy("k")
    t = t.withColumn("ha", F.bit_xor("ha").over(run)).withColumn("hb", F.bit_xor("hb").over(run))
    return t.join(blocks, ["conv_id", "block"]).select("conv_id", "k", "n_turns", F.col("ha").bitwiseXOR(F.col("xa")).alias("a"), F.col("hb").bitwiseXOR(F.col("xb")).alias("b"))


def maximal(conversations: DataFrame) -> DataFrame:
    """conv_id, copies (equal conversations, itself included) of those that no longer conversation continues."""
    spark = conversations.sparkSession
    hashes = Scratch(spark, "chat").save(prefix_hashes(conversations), "hashes")
    whole = hashes.where("k = n_turns").groupBy("n_turns", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    begun = hashes.where("k < n_turns").select(F.col("k").alias("n_turns"), "a", "b").distinct()
    return whole.join(begun, ["n_turns", "a", "b"], "left_anti").select("conv_id", "copies")


def format_chats(conversations: DataFrame) -> DataFrame:
    """Maximal conversations as chat text: conv_id, part (from 0), n_turns, copies, chat.

    A part holds up to 64 turns, so that a conversation of any length is never gathered in one row; nearly all have one
    part. A turn reads ``<|role|>`` newline text ``<|end|>`` newline; a null role reads ``unknown``, a null text as
    empty, though both differ from these words when conversations are compared. Rows with a null conv_id belong to no
    conversation and are left out. Null turns come first; equal turn numbers are ordered by role and text; repeated
    rows count as turns of their own. Other columns are not read. An empty table gives an empty result.
    """
    kept = maximal(conversations)
    t = _turns(conversations.join(kept.select("conv_id"), "conv_id", "left_semi"))
    said = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n"))
    parts = t.groupBy("conv_id", F.floor((F.col("k") - 1) / PART).alias("part"), "n_turns").agg(F.array_sort(F.collect_list(F.struct("k", said.alias("said")))).alias("said"))
    parts = parts.withColumn("chat", F.array_join(F.col("said.said"), ""))
    return parts.join(kept, "conv_id").select("conv_id", "part", "n_turns", "copies", "chat")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


ORACLE = """
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY k) AS l,
         list('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) ORDER BY k) AS said
  FROM t GROUP BY conv_id),
e AS (SELECT l, min(conv_id) AS conv_id, count(*) AS copies FROM c GROUP BY l),
kept AS (
  SELECT e.conv_id, e.copies, c.n, c.said FROM e JOIN c USING (conv_id)
  WHERE NOT EXISTS (SELECT 1 FROM c AS d WHERE d.n > c.n AND d.l[1] = c.l[1] AND d.l[1:c.n] = c.l))
SELECT conv_id, CAST(p AS BIGINT) AS part, CAST(n AS BIGINT) AS n_turns, CAST(copies AS BIGINT) AS copies,
       array_to_string(said[64 * p + 1 : 64 * p + 64], '') AS chat
FROM kept, unnest(range((n + 63) // 64)) AS u(p)
"""
