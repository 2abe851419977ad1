import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from extentlake.llm.sharding import BUCKETS, CHUNK, ROUNDS, Feistel, query, shard


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**64 - 1))
def test_a_permutation_with_an_inverse(n, seed):
    law, x = Feistel(n, seed), np.arange(n)
    y = law.permute(x)
    assert sorted(y) == list(x)
    assert (law.invert(y) == x).all()


def check(rows, shards):
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values(), default=0) - min((sizes[s] for s in range(shards)), default=0) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


def test_nulls_ties_repeats_and_clashing_columns(spark):
    data = [(k, f"text é {k}", 1, 2) for k in range(200)] + [(5, "same", 0, 0)] * 60 + [(None, None, 3, 4), (None, "", 3, 4), (7, None, 1, 1)]
    rows = shard(spark.createDataFrame(data, "doc_id long, text string, shard int, _n int"), shards=7).collect()
    assert len(rows) == len(data)
    check(rows, 7)
    assert Counter((r.doc_id, r.bytes, r.text_crc32) for r in rows) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in data)
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}


def test_reproducible_whatever_the_partitions(spark):
    df = spark.createDataFrame([(k, f"t{k % 50}") for k in range(500)], "doc_id long, text string")
    one, two = ({(r.doc_id, r.shard, r.slot) for r in shard(x, 8).collect()} for x in (df.repartition(1), df.repartition(9)))
    assert one == two


@pytest.mark.parametrize("n", [0, 1, CHUNK + 3])
def test_empty_single_and_very_many_copies(spark, n):
    df = spark.range(n).selectExpr("1L AS doc_id", "'x' AS text")
    rows = shard(df, 4).collect()
    assert len(rows) == n
    check(rows, 4)


def brute_place(docs, shards, seed):
    """(doc_id, bytes, text_crc32, shard, slot) of (doc_id, text) rows, by plain integers: rows sorted by hash bucket and columns
    are numbered, the network is run on each number, and walked until it falls inside."""
    full, signed = (1 << 64) - 1, lambda x: x - (1 << 64) if x >> 63 else x

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & full
        x = (x ^ x >> 27) * 0x94D049BB133111EB & full
        return x ^ x >> 31

    def hashed(*values):
        h = 42
        for v in values:
            if v is not None:
                h = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else (v & full).to_bytes(8, "little"), h)
        return signed(h)

    rows = []
    for d, t in docs:
        raw = None if t is None else t.encode()
        row = (d, len(raw or b"") + 16, zlib.crc32(raw or b""), hashed(raw))
        rows.append((hashed(*row) % BUCKETS, row))
    rows.sort(key=lambda x: (x[0], tuple((v is not None, v or 0) for v in x[1])))
    n = len(rows)
    bits = max(2, (max(n, 1) - 1).bit_length())
    lo, hi = bits // 2, bits - bits // 2
    keys = [mix((k * 0x9E3779B97F4A7C15 + seed) & full) for k in range(1, ROUNDS + 1)]

    def once(x):
        left, right = x >> lo, x & (1 << lo) - 1
        for k in range(ROUNDS):
            if k % 2 == 0:
                left ^= mix((right + keys[k]) & full) & (1 << hi) - 1
            else:
                right ^= mix((left + keys[k]) & full) & (1 << lo) - 1
        return left << lo | right

    out = []
    for number, (_, (d, size, crc, _)) in enumerate(rows):
        x = once(number)
        while x >= n:
            x = once(x)
        out.append((d, size, crc, x % shards, x // shards))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    """The whole table of documents, and rows with nulls and repeats."""
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in query(spark, "/root/testdata/sf0.001").select("doc_id", "bytes", "text_crc32", "shard", "slot").collect()), key=str)
    assert got == brute_place(docs, 40, 20240229)
    odd = docs[:30] + [(None, "é"), (None, None), (5, ""), (5, ""), (5, None), (-3, "x" * 70)] * 2
    got = sorted((tuple(r) for r in shard(spark.createDataFrame(odd, "doc_id long, text string"), 7, 99).select("doc_id", "bytes", "text_crc32", "shard", "slot").collect()), key=str)
    assert got == brute_place(odd, 7, 99)
