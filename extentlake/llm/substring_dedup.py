"""Substring deduplication: Rabin-Karp hashes of every window of words, counted in Spark.

Every window of ``width`` consecutive words is hashed to 96 bits (64 bits that are sorted and counted, 32 more, of other hashes
of the words, that have to agree): of n windows, two different ones are taken for equal with a probability of about
n^2 / 2^97. A map task keeps, of a window that it meets often, the smallest document and sends the others straight to
removal, so a passage that a third of all documents share arrives once per task and not once per document. Removed
windows merge into maximal intervals of words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._buckets import bucket_count, cuts, dealt, first_buckets, pack_keys, runs, unpack_keys
from ._common import Scratch, table
from ._words import mix, parts

WIDTH = 50
#: Windows sorted at a time in a map task.
CHUNK = 1_500_000
_SECOND_BASE = 0xC2B2AE3D27D4EB4F | 1

_BLOCKS = "bucket int, keys binary, checks binary, owners binary, docs binary, hits binary"
_CLASSES = "doc_class int, docs binary, hits binary"
_HITS = "doc_id long, hits binary"


def _by_class(docs: np.ndarray, keys: np.ndarray, classes: int) -> list[tuple[int, bytes, bytes]]:
    """(class, documents, keys) of hits: documents are dealt into classes, so that a block holds many of them."""
    with np.errstate(over="ignore"):
        c = (mix(docs.view(np.uint64)) % np.uint64(classes)).astype(np.int64)
    order = np.argsort(c, kind="stable")
    docs, keys, c = docs[order], keys[order], c[order]
    at = runs(c)
    return [(int(c[a]), docs[a:b].astype("<i8").tobytes(), keys[a:b].astype("<u8").tobytes()) for a, b in zip(at[:-1], at[1:])]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in schema.split(", ")))
    types = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[k] for k in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], list(names))


def _chunk(keys, checks, docs, buckets: int, classes: int) -> pa.RecordBatch:
    """Blocks of the smallest document of each window; hits of the others."""
    order = np.lexsort((docs, keys))
    keys, checks, docs = keys[order], checks[order], docs[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])
    start = np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))
    more = ~first & (docs != docs[start])
    # Hits travel along with the bucket of the same number as their class.
    rows = [(c, None, None, None, d, h) for c, d, h in _by_class(docs[more], keys[more], classes)]
    keys, checks, docs = keys[first], checks[first], docs[first]
    for b, at in cuts(keys, buckets):
        own, owner = np.unique(docs[at], return_inverse=True)
        rows.append((b, pack_keys(keys[at]), checks[at].tobytes(), owner.astype("<u4" if len(own) > 65536 else "<u2").tobytes(), own.astype("<i8").tobytes(), None))
    return _batch(rows, _BLOCKS)


def _chunks(arrays, buckets: int, classes: int):
    """Blocks of (keys, checks, documents) arrays, as soon as CHUNK windows are held."""
    held, n = [], 0
    for some in arrays:
        held.append(some)
        n += len(some[0])
        if n >= CHUNK:
            yield _chunk(*(np.concatenate(c) for c in zip(*held)), buckets, classes)
            held, n = [], 0
    if n:
        yield _chunk(*(np.concatenate(c) for c in zip(*held)), buckets, classes)


def _windows(batches, width: int):
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for p in parts(batch.column(1), width - 1):
            at = p.words.window_starts(width)
            yield p.words.window_hashes(at, width), p.words.window_hashes(at, width, _SECOND_BASE, check=True).astype("<u4"), ids[p.row : p.end][p.words.docs[at]]


def _unblock(keys, checks, owners, docs):
    docs = np.frombuffer(docs, "<i8")
    return unpack_keys(keys), np.frombuffer(checks, "<u4"), docs[np.frombuffer(owners, "<u2" if len(docs) <= 65536 else "<u4")]


def _resplit(batches, buckets: int):
    """Blocks of the first buckets, dealt into the final ones."""
    hits = []

    def blocks():
        for batch in batches:
            for r in batch.to_pylist():
                if r["hits"] is None:
                    yield _unblock(r["keys"], r["checks"], r["owners"], r["docs"])
                else:
                    hits.append(tuple(r.values()))

    for out in _chunks(blocks(), buckets, buckets):
        yield out
        yield _batch(hits, _BLOCKS)
        hits.clear()
    yield _batch(hits, _BLOCKS)


def _count(t: pa.Table, classes: int) -> pa.Table:
    """Hits of one bucket by class: each window's documents but the smallest."""
    rows = zip(*(t.column(c).to_pylist() for c in ("keys", "checks", "owners", "docs")))
    blocks = [_unblock(*r) for r in rows if r[0] is not None]
    passed = t.filter(pa.compute.is_valid(t.column("hits"))).select(["bucket", "docs", "hits"]).rename_columns(["doc_class", "docs", "hits"])
    keys, checks, docs = (np.concatenate([np.zeros(0, kind), *c]) for c, kind in zip(zip(*blocks) if blocks else [[]] * 3, (np.uint64, "<u4", np.int64)))
    order = np.argsort(keys, kind="stable")
    new = runs(keys[order])
    order = order[np.repeat(np.diff(new) > 1, np.diff(new))]
    keys, checks, docs = keys[order], checks[order], docs[order]
    order = np.lexsort((docs, checks, keys))
    keys, checks, docs = keys[order], checks[order], docs[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])
    start = np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0)) if len(keys) else np.zeros(0, int)
    more = docs != docs[start]
    return pa.concat_tables([passed, pa.Table.from_batches([_batch(_by_class(docs[more], keys[more], classes), _CLASSES)])])


def _unpack(t: pa.Table) -> pa.Table:
    """One row for each document of a class."""
    docs, keys = (np.concatenate([np.frombuffer(x, k) for x in t.column(c).to_pylist()]) for c, k in (("docs", "<i8"), ("hits", "<u8")))
    order = np.argsort(docs, kind="stable")
    docs, keys = docs[order], keys[order]
    at = runs(docs)
    return pa.Table.from_batches([_batch([(int(docs[a]), keys[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])], _HITS)])


def repeated_windows(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, hits: hashes of the windows of a document that also start in one with a smaller id."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    buckets = bucket_count(docs)
    blocks = docs.mapInArrow(lambda b: _chunks(_windows(b, width), first_buckets(buckets), buckets), _BLOCKS)
    blocks = dealt(blocks, buckets, lambda b: _resplit(b, buckets))
    classes = blocks.groupBy("bucket").applyInArrow(lambda t: _count(t, buckets), _CLASSES)
    return classes.groupBy("doc_class").applyInArrow(_unpack, _HITS)


_OUT = "doc_id long, n_words long, spans array<struct<start:int,end:int>>, kept string"


def _spans(off: np.ndarray, first: int) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], off, [False]]).astype(np.int8))) + first
    return [(int(s), int(e)) for s, e in zip(edges[::2], edges[1::2])]


def _remove(batches, width: int):
    """Every word of every text once: of a part, the last width - 1 words wait for the windows of the next part."""
    for batch in batches:
        ids, texts, hits = batch.columns[:3]
        wanted = [np.frombuffer(h, "<u8") if h else None for h in hits.to_pylist()]
        n, spans, kept = [0] * len(wanted), [[] for _ in wanted], [b""] * len(wanted)
        carry = np.zeros(0, bool)
        for p in parts(texts, width - 1):
            w = p.words
            step = np.zeros(len(w.starts) + 1, np.int64)
            own = [i for i in range(p.row, p.end) if wanted[i] is not None]
            if own:
                starts = w.window_starts(width)
                windows, edge = w.window_hashes(starts, width), np.searchsorted(starts, w.bounds)
                for i in own:
                    here = slice(edge[i - p.row], edge[i - p.row + 1])
                    gone = starts[here][np.isin(windows[here], wanted[i])]
                    np.add.at(step, gone, 1)
                    np.add.at(step, gone + width, -1)
            off = np.cumsum(step[:-1]) > 0
            off[: p.skip] |= carry
            settled = len(off) if p.last else len(off) - (width - 1)
            carry = off[settled:]
            keep = ~off
            keep[settled:] = False
            out, ends = w.joined(keep)
            for i in range(p.row, p.end):
                a, b = w.bounds[i - p.row], min(w.bounds[i - p.row + 1], settled)
                if i in own:
                    spans[i] += _spans(off[a:b], n[i])
                n[i] += int(b - a)
                kept[i] += out[ends[i - p.row] : ends[i - p.row + 1]]
        # A passage that goes on in the next part has two touching spans.
        for s in spans:
            for k in range(len(s) - 1, 0, -1):
                if s[k - 1][1] == s[k][0]:
                    s[k - 1 : k + 1] = [(s[k - 1][0], s[k][1])]
        spans = [[{"start": s, "end": e} for s, e in x] for x in spans]
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array([k[:-1].decode() for k in kept], pa.string()), *batch.columns[3:]], [*(f.split()[0] for f in _OUT.split(", ")[:2]), "spans", "kept", *batch.schema.names[3:]])


def deduplicate(documents: DataFrame, width: int = WIDTH, carry: list[str] = ()) -> DataFrame:
    """doc_id, n_words, spans (maximal intervals of removed words), kept (the other words, joined by a space) of every row;
    and the columns of ``carry``, unchanged.

    Words are runs of anything but ASCII white space. A word goes if a window of ``width`` words that covers it also starts
    in a document of smaller id; windows are judged on the input. Null and empty texts have no words. Rows with a null id
    are kept whole and make nobody else's words go. Rows that repeat an id don't remove each other; what a smaller id holds
    is removed from each. Columns that aren't named are not read; an empty table gives an empty result.
    """
    hits = Scratch(documents.sparkSession, "substrings").save(repeated_windows(documents, width), "hits")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *[F.col(c).alias(f"_{k}") for k, c in enumerate(carry)])
    rows = rows.join(hits, "doc_id", "left").select("doc_id", "text", "hits", *[f"_{k}" for k in range(len(carry))])
    types = "".join(f", _{k} {documents.schema[c].dataType.simpleString()}" for k, c in enumerate(carry))
    out = rows.mapInArrow(lambda b: _remove(b, width), _OUT + types)
    return out.select("doc_id", "n_words", "spans", "kept", *[F.col(f"_{k}").alias(c) for k, c in enumerate(carry)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 49], ' ') AS k FROM w, unnest(range(1, len(ws) - 48)) AS t(i) WHERE len(ws) >= 50),
m AS (SELECT k, min(doc_id) AS d FROM p GROUP BY k),
g AS (SELECT DISTINCT p.doc_id, i + j AS pos FROM p JOIN m USING (k), unnest(range(50)) AS u(j) WHERE m.d < p.doc_id),
r AS (SELECT doc_id, list(pos) AS ats FROM g GROUP BY doc_id),
k AS (
  SELECT w.doc_id, ws, coalesce(len(ats), 0) AS gone,
         CASE WHEN ats IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(ats, i)), lambda i: ws[i]) END AS kept
  FROM w LEFT JOIN r USING (doc_id))
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(gone AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
