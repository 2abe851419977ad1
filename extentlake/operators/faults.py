"""Injected faults as functions of frames: what tests and drills do to journals, blobs and parity files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flipped(content: Column, at: int) -> Column:
    """The bytes with the one at ``at`` replaced by its complement; shorter ones stay."""
    byte = F.conv(F.hex(F.substr(content, F.lit(at + 1), F.lit(1))), 16, 10).cast("int")
    other = F.unhex(F.lpad(F.hex(byte.bitwiseXOR(F.lit(255))), 2, "0"))
    return F.when(F.octet_length(content) > at, F.concat(F.substr(content, F.lit(1), F.lit(at)), other, F.substr(content, F.lit(at + 2), F.octet_length(content)))).otherwise(content)


def cut(content: Column, n: int) -> Column:
    """Without the last n bytes."""
    return F.substr(content, F.lit(1), F.greatest(F.octet_length(content) - n, F.lit(0)))


def lost(blobs: DataFrame, hit: Column) -> DataFrame:
    """Without the blobs that are hit."""
    return blobs.where(~F.coalesce(hit, F.lit(False)))


def damaged(blobs: DataFrame, hit: Column, change) -> DataFrame:
    return blobs.withColumn("content", F.when(hit, change(F.col("content"))).otherwise(F.col("content")))
