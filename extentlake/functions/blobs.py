"""Functions on blobs: lengths, slices, codecs, synthetic contents."""

from __future__ import annotations

import gzip
import lzma
import struct

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the frame: a codec's number, a reserved byte, the payload's length.
CODEC_IDS = {"": 0, "zstd": 1, "lz4": 2, "snappy": 3, "gzip": 4, "xz": 5}
_FRAME = ">BBI"


def with_length(blob: Column, n: Column) -> Column:
    """Cut or zero-padded to n bytes (a negative n counts as 0)."""
    n = F.greatest(n, F.lit(0)).cast("int")
    return F.when(F.octet_length(blob) == n, blob).when(n == 0, F.lit(b"")).otherwise(F.rpad(F.substr(blob, F.lit(1), n), n, F.lit(b"\0")))


def slice_of(blob: Column, offset: Column, n: Column) -> Column:
    """n bytes from an offset, zero-padded where the blob ends."""
    return with_length(F.substr(blob, (offset + 1).cast("int"), n.cast("int")), n)


def ratio(plain: Column, packed: Column) -> Column:
    return F.when((plain == 0) | (packed == 0), F.lit(1.0)).otherwise(packed / plain)


def compress(data: bytes, codec: str) -> bytes:
    """A frame: number, reserved byte, 32-bit length, payload; lz4 and snappy payloads begin with the plain length."""
    if codec == "gzip":
        out = gzip.compress(data, mtime=0)
    elif codec == "xz":
        out = lzma.compress(data)
    elif codec in ("zstd", "lz4", "snappy"):
        out = struct.pack(">I", len(data)) + pa.Codec({"lz4": "lz4_raw"}.get(codec, codec)).compress(data, asbytes=True)
    elif codec == "":
        out = data
    else:
        raise ValueError(f"unsupported codec: {codec}")
    return struct.pack(_FRAME, CODEC_IDS[codec], 0, len(out)) + out


def decompress(frame: bytes) -> bytes:
    number, _, size = struct.unpack_from(_FRAME, frame)
    codec = {v: k for k, v in CODEC_IDS.items()}.get(number)
    out = frame[struct.calcsize(_FRAME) :]
    if codec is None or len(out) != size:
        raise ValueError("no frame")
    if codec == "gzip":
        return gzip.decompress(out)
    if codec == "xz":
        return lzma.decompress(out)
    if codec:
        return pa.Codec({"lz4": "lz4_raw"}.get(codec, codec)).decompress(out[4:], struct.unpack_from(">I", out)[0], asbytes=True)
    return out


def compress_column(blob: Column, codec: Column) -> Column:
    @F.pandas_udf("binary")
    def run(data: pd.Series, codecs: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else compress(d, c) for d, c in zip(data, codecs)])

    return run(blob, codec)


def decompress_column(frame: Column) -> Column:
    @F.pandas_udf("binary")
    def run(frames: pd.Series) -> pd.Series:
        return pd.Series([None if f is None else decompress(f) for f in frames])

    return run(frame)


def synthetic_hex(seed: Column, n_hex: Column) -> Column:
    """n hex digits of chained digests of a seed: each block is the digest of the one before it (as hex text)."""
    blocks = F.sequence(F.lit(1), F.greatest(F.ceil(n_hex / 64) - 1, F.lit(0)).cast("int"))
    start = F.struct(F.sha2(seed, 256).alias("last"), F.sha2(seed, 256).alias("all"))
    step = lambda s, _: F.struct(F.sha2(s["last"], 256).alias("last"), F.concat(s["all"], F.sha2(s["last"], 256)).alias("all"))
    more = F.aggregate(F.when(n_hex > 64, blocks).otherwise(F.array().cast("array<int>")), start, step)
    return F.substr(more["all"], F.lit(1), n_hex.cast("int"))
