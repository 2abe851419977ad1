"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items that share a seed (a run of ``min_match`` words) are joined on the seed's rolling hash. For
each such pair the longest common run of unmarked words is marked again and again, until none of ``min_match`` words is
left; the tiles are found by Karp-Rabin hashes of the seeds, extended along their diagonals. The share of the item's words
under tiles decides, so an item whose sentences were put in another order is caught as well. An item of fewer than
``min_match`` words is found where it is all that a document says.
"""

from __future__ import annotations

import heapq
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, process_cache, table
from ._words import Words, parts

#: Short enough for the short sentences of a reordered item; the coverage decides.
MIN_MATCH = 3
COVERAGE = 0.5
#: The benchmark is broadcast up to this many bytes of text and joined by a shuffle beyond.
BROADCAST_BYTES = 16_000_000

_PAIRS = "doc_id long, item_id long, item_words int, covered_words int, tiles int, longest_tile int"

#: Words are runs of anything but ASCII white space, control characters and punctuation.
_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


class Text:
    """Word hashes of a whole text, and (hash, place) of its windows of k words; a shorter text is one window."""

    def __init__(self, words: np.ndarray, seeds: np.ndarray, at: np.ndarray):
        self.words, self.seeds, self.at = words, seeds, at


def _texts(array, k: int, wanted=None):
    """(row, Text) of the lower-cased texts; of a text in parts only the windows whose hashes are ``wanted`` (a mask of them)."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for p in parts(pa.compute.utf8_lower(array), k - 1, space=_BREAK):
        w = p.words
        at = w.window_starts(k)
        h = w.window_hashes(at, k)
        if held or not p.last:
            before = sum(len(x[0]) for x in held) - p.skip
            if wanted:
                at, h = (x[wanted(h)] for x in (at, h))
            held.append((w.hashes[p.skip :], h, at + max(0, before)))
            if p.last:
                yield p.row, Text(*(np.concatenate(x) for x in zip(*held)))
                held = []
            continue
        edge = np.searchsorted(at, w.bounds)
        short = np.flatnonzero((w.counts > 0) & (w.counts < k))
        whole = dict(zip(short.tolist(), w.whole_hashes(short)))
        for i in range(p.end - p.row):
            a, b = w.bounds[i], w.bounds[i + 1]
            if i in whole:
                yield p.row + i, Text(w.hashes[a:b], np.array([whole[i]]), np.zeros(1, np.int64))
            else:
                yield p.row + i, Text(w.hashes[a:b], h[edge[i] : edge[i + 1]], at[edge[i] : edge[i + 1]] - a)


def tiles(item: np.ndarray, text: np.ndarray, starts_item: np.ndarray, starts_text: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word-hash sequences: (start in item, start in text, length), longest first.

    ``starts_*`` are the pairs of positions whose seeds agree. Runs of seeds on one diagonal are the maximal matches; a
    match that meets marked words is cut to its unmarked runs and queued again. Ties go to the earlier place.
    """
    diagonal = starts_text - starts_item
    order = np.lexsort((starts_item, diagonal))
    a, d = starts_item[order], diagonal[order]
    new = np.flatnonzero(np.r_[True, (np.diff(d) != 0) | (np.diff(a) != 1)]) if len(a) else np.zeros(0, int)
    ends = np.r_[new[1:], len(a)] if len(a) else new
    queue = [(-int(a[e - 1] - a[s] + min(min_match, len(item))), int(a[s]), int(a[s] + d[s])) for s, e in zip(new, ends)]
    heapq.heapify(queue)
    marked_item, marked_text, out = np.zeros(len(item), bool), np.zeros(len(text), bool), []
    while queue:
        length, i, j = heapq.heappop(queue)
        length = -length
        taken = marked_item[i : i + length] | marked_text[j : j + length]
        if not taken.any():
            marked_item[i : i + length] = marked_text[j : j + length] = True
            out.append((i, j, length))
            continue
        edges = np.flatnonzero(np.diff(np.r_[True, taken, True].astype(np.int8)))
        for s, e in zip(edges[::2], edges[1::2]):
            if e - s >= min_match:
                heapq.heappush(queue, (-int(e - s), i + int(s), j + int(s)))
    return out


class Seeds:
    """All seeds of the benchmark, sorted, behind a bit table that turns away nearly all other windows."""

    def __init__(self, items: list[tuple[int, str]], min_match: int):
        self.k, self.ids, self.words, seeds, place = min_match, [i for i, _ in items], [], [], []
        for _, t in _texts(pa.array([t for _, t in items], pa.large_string()), min_match):
            self.words.append(t.words)
            seeds.append(t.seeds)
            place.append(t.at)
        owner = np.repeat(np.arange(len(seeds)), [len(h) for h in seeds])
        h, p = (np.concatenate([np.zeros(0, t), *x]) for t, x in ((np.uint64, seeds), (np.int64, place)))
        order = np.argsort(h, kind="stable")
        self.hash, self.owner, self.place = h[order], owner[order], p[order]
        self.bits = np.uint64(min(24, max(16, 4 + len(h).bit_length())))
        self.table = np.zeros(1 << int(self.bits), bool)
        self.table[self.hash >> (np.uint64(64) - self.bits)] = True

    def near(self, hashes: np.ndarray) -> np.ndarray:
        return self.table[hashes >> (np.uint64(64) - self.bits)]

    def find(self, t: Text):
        """(item, covered words, tiles, longest) of the items that share a seed with the text."""
        near = self.near(t.seeds)
        at, h = t.at[near], t.seeds[near]
        lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        n = hi - lo
        if not n.sum():
            return
        hit = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at, item, place = np.repeat(at, n), self.owner[hit], self.place[hit]
        order = np.argsort(item, kind="stable")
        item, place, at = item[order], place[order], at[order]
        cuts = np.flatnonzero(np.r_[True, np.diff(item) != 0, True])
        for a, b in zip(cuts[:-1], cuts[1:]):
            got = tiles(self.words[item[a]], t.words, place[a:b], at[a:b], self.k)
            yield item[a], sum(x[2] for x in got), len(got), got[0][2]


def _rows(rows, carried, batch) -> pa.RecordBatch:
    """Found rows, with the carried columns of the batch's rows ``carried``."""
    types = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
    own = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types)]
    more = [batch.column(k).take(pa.array(carried, pa.int64())) for k in range(4, batch.num_columns)]
    return pa.RecordBatch.from_arrays([*own, *more], [*(f.split()[0] for f in _PAIRS.split(", ")), *batch.schema.names[4:]])


def _scan(batches, items, key: str, k: int, coverage: float):
    """The seeds are built once for a worker."""
    kept = process_cache()
    if kept.get("seeds of", None) != key:
        kept["seeds of"], kept["seeds"] = key, Seeds(items.value, k)
    seeds = kept["seeds"]
    for batch in batches:
        ids, rows, carried = batch.column(0), [], []
        for row, t in _texts(batch.column(1), k, seeds.near):
            for item, covered, count, longest in seeds.find(t):
                if covered >= coverage * len(seeds.words[item]):
                    rows.append((ids[row].as_py(), seeds.ids[item], len(seeds.words[item]), covered, count, longest))
                    carried.append(row)
        yield _rows(rows, carried, batch)


def _seed_rows(batches, k: int):
    """(id, distinct seeds) rows for the join by shuffle."""
    for batch in batches:
        for row, t in _texts(batch.column(1), k):
            h = np.unique(t.seeds)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), batch.column(0)[row].as_py(), np.int64)), pa.array(h.view(np.int64))], ["id", "seed"])


def _tile_pairs(batches, k: int, coverage: float):
    for batch in batches:
        rows, carried = [], []
        for at, (doc_id, text, item_id, item) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:4]))):
            seeds = Seeds([(item_id, item)], k)
            for _, t in _texts(pa.array([text], pa.large_string()), k):
                for _, covered, count, longest in seeds.find(t):
                    if covered >= coverage * len(seeds.words[0]):
                        rows.append((doc_id, item_id, len(seeds.words[0]), covered, count, longest))
                        carried.append(at)
        yield _rows(rows, carried, batch)


def contaminated(documents: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, broadcast_bytes: int = BROADCAST_BYTES, carry: list[str] = ()) -> DataFrame:
    """doc_id, item_id, item_words, covered_words, tiles, longest_tile, coverage of each pair with at least ``coverage`` of
    the item's words under tiles of ``min_match`` words or more; and the documents' columns of ``carry``, unchanged.

    Words are compared in lower case, without ASCII punctuation. An item of fewer than ``min_match`` words is found in the
    documents that consist of it. Null or empty texts hold no words; null ids are kept as nulls. Equal items are each
    reported; repeated rows are reported once each. Other columns are not read. An empty table on either side gives an
    empty result.
    """
    spark = documents.sparkSession
    more = [f"_{k}" for k in range(len(carry))]
    schema = _PAIRS + "".join(f", _{k} {documents.schema[c].dataType.simpleString()}" for k, c in enumerate(carry))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), *[F.col(c).alias(m) for c, m in zip(carry, more)])
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item")).where(F.length("item") > 0)
    if (items.agg(F.sum(F.octet_length("item"))).first()[0] or 0) <= broadcast_bytes:
        held, key = spark.sparkContext.broadcast([tuple(r) for r in items.collect()]), uuid.uuid4().hex
        rows = docs.select("doc_id", "text", F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("string").alias("item"), *more)
        pairs = rows.mapInArrow(lambda b: _scan(b, held, key, min_match, coverage), schema)
    else:
        scratch = Scratch(spark, "decontaminate")
        of = lambda df, key: df.mapInArrow(lambda b: _seed_rows(b, min_match), "id long, seed long").withColumnRenamed("id", key)
        docs = scratch.save(docs.withColumn("_row", F.monotonically_increasing_id()), "docs")
        items = scratch.save(items.withColumn("_item", F.monotonically_increasing_id()), "items")
        both = of(docs.select("_row", "text"), "_row").join(of(items.select("_item", "item"), "_item"), "seed").select("_row", "_item").distinct()
        both = both.join(docs, "_row").join(items, "_item").select("doc_id", "text", "item_id", "item", *more)
        pairs = both.mapInArrow(lambda b: _tile_pairs(b, min_match, coverage), schema)
    pairs = pairs.withColumn("coverage", F.col("covered_words") / F.col("item_words"))
    return pairs.select(*[c for c in pairs.columns if c not in more], *[F.col(m).alias(c) for c, m in zip(carry, more)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
