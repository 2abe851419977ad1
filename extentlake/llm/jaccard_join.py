"""Exact n-gram Jaccard join by universe partitioning and the pigeonhole principle.

Texts are sets of hashed word shingles. A size band cuts the universe of shingles into segments by a hash; sets of
Jaccard similarity 3/4 or more differ in at most (|x| + |y|) / 7 shingles, so of any (|x| + |y|) / 7 + 1 segments one holds
the same subset on both sides. Sets are indexed by the hashes of their non-empty segment subsets, and the counts of these
hashes are the costs: a set leaves out as many of its costliest segments as the pigeonhole allows.

This is done twice. A coarse partition of all sets (two or three shingles a segment, few hashes) counts alone: a set that
shares no more segments than it may leave out meets nobody and is done. A fine partition of the sets that are left (most
segments hold one shingle) leaves out up to two thirds of a set, so a passage that many texts share makes no candidates.
In the bands of the smallest sets, where shingles may crowd into too few segments, the subsets short of one shingle are
indexed too, and such a segment counts twice. Candidates are verified on whole sets.

A large group of sets behind one segment hash is first compared with its smallest member alone. Groups that the links'
components leave open are compared in tiles of two blocks of sets (their incidence matrices are multiplied), except within
the group's largest component; a tile returns only links that join components, not pairs.

Shingles have 64-bit hashes, equal sets 128-bit ones: two different shingles of one pair of sets are taken for one with a
probability of about |x| |y| / 2^64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._buckets import bucket_count, cuts, dealt, first_buckets, pack_keys, runs, unpack_keys
from ._common import Scratch, table
from ._graph import components
from ._words import mix, shingle_sets

K = 5
#: Segments per shingle at a band's upper size in the coarse and the fine partition, and at least so many.
COARSE, FINE, MIN_SEGMENTS = 0.45, 8.0, 64
#: Bands up to this (sets of up to 2^TINY shingles) also index subsets short of one shingle.
TINY = 4
CHUNK_KEYS, CHUNK_SETS = 1_000_000, 15_000
#: Keys of sets above this many shingles are made part by part.
LARGE_SET = 1_000_000
#: Groups of up to this many sets are compared pair by pair at once; larger ones in blocks of so many.
SMALL_GROUP, BLOCK_SETS = 3, 256
#: Shingles multiplied at a time in a tile.
TILE_SHINGLES = 4096

U = np.uint64
_LOW, _SHORT, _PROBE, _INDEX = 1, 2, 4, 8  # flags of a key: from the band above; short of one shingle; probes; is indexed


def band(n):
    """Band b holds the sizes above 2^(b-1) up to 2^b."""
    return np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)


def segments(b, density):
    return np.maximum(MIN_SEGMENTS, np.ceil(density * 2.0**b)).astype(np.int64)


def needed(n, b, low):
    """Segments that set x of n shingles must try so that every linked y, of its own band and not larger or of the band
    below, shares one: the largest possible difference, plus one."""
    return np.where(low, (n + np.minimum(n, 2**b)) // 7, 2 * n // 7) + 1


def set_keys(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each of the sets h[at[i]:at[i + 1]]."""
    with np.errstate(over="ignore"):
        sums = [np.concatenate([[U(0)], np.cumsum(mix(h + U(s)), dtype=U)]) for s in (1, 2)]
        return tuple((s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums)


def _sets(batches, k: int):
    for batch in batches:
        for row, end, h, at in shingle_sets(batch.column(1), k):
            k1, k2 = set_keys(h, at)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), batch.column(2).slice(row, end - row), pa.array(np.diff(at)), pa.array(k1), pa.array(k2)], ["doc_id", "text_hash", "n", "k1", "k2"])


class _Chunk:
    """Keys of some sets, to be sorted and sent off in blocks; entry: which set in which role."""

    def __init__(self):
        self.keys, self.entry, self.flags, self.entries, self.size, self.sets = [], [], [], [], 0, 0

    def add(self, keys, entry, flags, entries):
        self.keys.append(keys)
        self.entry.append(entry + self.sets)
        self.flags.append(flags)
        self.entries.append(entries)
        self.size += len(keys)
        self.sets += len(entries)

    def full(self) -> bool:
        return self.size >= CHUNK_KEYS or self.sets >= CHUNK_SETS

    def blocks(self, buckets: int) -> pa.RecordBatch:
        keys, entry, flags, entries = (np.concatenate(c) for c in (self.keys, self.entry, self.flags, self.entries))
        order = np.argsort(keys, kind="stable")
        keys, entry, flags = keys[order], entry[order], flags[order]
        rows = []
        for b, s in cuts(keys, buckets):
            own, e = np.unique(entry[s], return_inverse=True)
            rows.append((b, pack_keys(keys[s]), e.astype("<u4" if len(own) > 65536 else "<u2").tobytes(), flags[s].tobytes(), entries[own].tobytes()))
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), *[pa.binary()] * 4])], ["bucket", "keys", "entry", "flags", "entries"])


_BLOCKS = "bucket int, keys binary, entry binary, flags binary, entries binary"
#: id, size, non-empty segments (and the size's band, own or below) of a set in a role.
_ENTRY = np.dtype([("id", "<i8"), ("n", "<i4"), ("u", "<i4"), ("b", "i1"), ("low", "i1")])


def _segment(h, b, density):
    """The segment of each shingle in its set's band."""
    with np.errstate(over="ignore"):
        return (mix(h ^ (U(0x5851F42D4C957F2D) * b.astype(U))) % segments(b, density).astype(U)).astype(np.int64)


def _role(h, at, ids, n, b, low, density):
    """Keys, entries' numbers, flags and entries of the sets h[at[i]:at[i + 1]] in band b."""
    size = np.diff(at)
    owner = np.repeat(np.arange(len(size)), size)
    seg = _segment(h, b[owner], density)
    with np.errstate(over="ignore"):
        order = np.argsort(owner * (1 << 40) + seg, kind="stable")
        owner, seg, value = owner[order], seg[order], mix(h[order] + U(3))
        new = runs(owner * (1 << 40) + seg)[:-1]
        total = np.add.reduceat(value, new) if len(value) else value
        salt = mix(seg.astype(U) + (b.astype(U)[owner] << U(40)) + U(4))
        u = np.bincount(owner[new], minlength=len(size))
        keys, entry, flags = [mix(total ^ salt[new])], [owner[new]], [np.where(low[owner[new]], _LOW, 0).astype(np.uint8)]
        count = np.diff(np.concatenate([new, [len(value)]]))
        short = np.flatnonzero(np.repeat(count > 1, count) & (b[owner] <= TINY))
        if len(short):
            keys.append(mix((np.repeat(total, count)[short] - value[short]) ^ salt[short]))
            entry.append(owner[short])
            flags.append((np.where(low[owner[short]], _LOW, 0) | _SHORT).astype(np.uint8))
    entries = np.empty(len(size), _ENTRY)
    entries["id"], entries["n"], entries["u"], entries["b"], entries["low"] = ids, n, u, b, low
    return np.concatenate(keys), np.concatenate(entry), np.concatenate(flags), entries


def _large_role(h, doc_id, b, low, density):
    """``_role`` of one large set, in parts of about LARGE_SET shingles that hold whole segments."""
    n, b = len(h), np.array([b])
    seg = np.concatenate([_segment(h[a : a + LARGE_SET], b, density) for a in range(0, n, LARGE_SET)]).astype(np.uint32)
    total = int(segments(b, density)[0])
    seen = np.zeros(total, bool)
    seen[seg] = True
    u, cut = int(seen.sum()), -(-n // LARGE_SET)
    for k in range(cut):
        part = h[(seg >= total * k // cut) & (seg < total * (k + 1) // cut)]
        keys, entry, flags, entries = _role(part, np.array([0, len(part)]), [doc_id], [n], b, np.array([low]), density)
        entries["u"] = u
        yield keys, entry, flags, entries


def _emit(batches, k: int, buckets: int, density: float):
    chunk = _Chunk()
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for row, end, h, at in shingle_sets(batch.column(1), k):
            n = np.diff(at)
            b = band(n)
            for low, chosen in ((False, n > 0), (True, (b > 0) & (3 * n <= 4 * 2 ** np.maximum(b - 1, 0)))):
                for i in np.flatnonzero(chosen & (n > LARGE_SET)):
                    for part in _large_role(h[at[i] : at[i + 1]], ids[row + i], b[i] - low, low, density):
                        chunk.add(*part)
                        if chunk.full():
                            yield chunk.blocks(buckets)
                which = np.flatnonzero(chosen & (n <= LARGE_SET))
                if not len(which):
                    continue
                part = np.concatenate([h[at[i] : at[i + 1]] for i in which])
                chunk.add(*_role(part, np.concatenate([[0], np.cumsum(n[which])]), ids[row:end][which], n[which], b[which] - low, np.full(len(which), low), density))
            if chunk.full():
                yield chunk.blocks(buckets)
    if chunk.size:
        yield chunk.blocks(buckets)


def _resplit(batches, buckets: int):
    """Blocks of the first buckets, dealt into the final ones."""
    chunk = _Chunk()
    for batch in batches:
        for r in batch.to_pylist():
            entries = np.frombuffer(r["entries"], _ENTRY)
            chunk.add(unpack_keys(r["keys"]), np.frombuffer(r["entry"], "<u2" if len(entries) <= 65536 else "<u4").astype(np.int64), np.frombuffer(r["flags"], np.uint8), entries)
            if chunk.full():
                yield chunk.blocks(buckets)
    if chunk.size:
        yield chunk.blocks(buckets)


def _read_blocks(t: pa.Table):
    """keys (ascending), flags, entry numbers and entries of a bucket's blocks; only keys that occur more than once."""
    rows = list(zip(*(t.column(c).to_pylist() for c in ("keys", "entry", "flags", "entries"))))
    keys = np.concatenate([np.zeros(0, U), *[unpack_keys(r[0]) for r in rows]])
    order = np.argsort(keys, kind="stable")
    size = np.diff(runs(keys[order])) if len(keys) else np.zeros(0, int)
    order = order[np.repeat(size > 1, size)]
    entries, entry, base = [np.zeros(0, _ENTRY)], [np.zeros(0, np.int64)], 0
    for r in rows:
        e = np.frombuffer(r[3], _ENTRY)
        entries.append(e)
        entry.append(base + np.frombuffer(r[1], "<u2" if len(e) <= 65536 else "<u4").astype(np.int64))
        base += len(e)
    flags = np.concatenate([np.zeros(0, np.uint8), *[np.frombuffer(r[2], np.uint8) for r in rows]])
    return keys[order], flags[order], np.concatenate(entry)[order], np.concatenate(entries)


def _shared_runs(t: pa.Table):
    """Of every set in every role, the bucket's keys that another set has too and an indexed set has: keys, costs (indexed
    sets that have the key), flags, starts of the sets' runs, entries of the runs."""
    keys, flags, entry, entries = _read_blocks(t)
    ids = entries["id"][entry]
    new = runs(keys)
    if len(keys):
        own = np.add.reduceat(((flags & _LOW) == 0).astype(np.int64), new[:-1])
        several = np.minimum.reduceat(ids, new[:-1]) != np.maximum.reduceat(ids, new[:-1])
        keep, cost = np.repeat(several & (own > 0), np.diff(new)), np.repeat(own, np.diff(new))
        keys, flags, entry, cost = keys[keep], flags[keep], entry[keep], cost[keep]
    else:
        cost = np.zeros(0, np.int64)
    order = np.argsort(entry, kind="stable")
    at = runs(entry[order])
    return keys[order], np.minimum(cost[order], 2**31 - 1), flags[order], at, entries[entry[order][at[:-1]]] if len(entry) else entries[:0]


def _classes_of(ids: np.ndarray, classes: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(ids.view(U) if ids.flags.c_contiguous else np.ascontiguousarray(ids).view(U)) % U(classes)).astype(np.int64)


_COUNTED = "cls int, entries binary, whole binary"


def _counted(t: pa.Table, classes: int) -> pa.Table:
    """Shared whole segments of the sets of a bucket, in blocks by class of the sets' ids."""
    _, _, flags, at, e = _shared_runs(t)
    whole = np.add.reduceat((flags & _SHORT) == 0, at[:-1], dtype=np.int64).astype("<i4") if len(e) else np.zeros(0, "<i4")
    c = _classes_of(e["id"], classes)
    order = np.argsort(c, kind="stable")
    cut = runs(c[order])
    rows = [(int(c[order[a]]), e[order[a:b]].tobytes(), whole[order[a:b]].tobytes()) for a, b in zip(cut[:-1], cut[1:])]
    return pa.table({"cls": pa.array([r[0] for r in rows], pa.int32()), "entries": pa.array([r[1] for r in rows], pa.binary()), "whole": pa.array([r[2] for r in rows], pa.binary())})


def _may_link(t: pa.Table) -> pa.Table:
    """Ids of a class whose sets share enough whole segments to probe (own band or below) or to be found by a larger set."""
    e = np.concatenate([np.frombuffer(x, _ENTRY) for x in t.column("entries").to_pylist()])
    whole = np.concatenate([np.frombuffer(x, "<i4") for x in t.column("whole").to_pylist()]).astype(np.int64)
    role, at = np.unique(e, return_inverse=True)
    whole = np.bincount(at, whole, len(role)).astype(np.int64)
    n, u, b, low = (role[c].astype(np.int64) for c in ("n", "u", "b", "low"))
    ok = (whole > u - needed(n, b, low > 0)) | (low == 0) & ((b <= TINY) | (whole >= u - n // 3))
    return pa.table({"doc_id": np.unique(role["id"][ok])})


_SHARED = "cls int, entries binary, sizes binary, keys binary, costs binary, flags binary"


def _shared(t: pa.Table, classes: int) -> pa.Table:
    """The shared keys themselves, with costs, in blocks by class."""
    keys, costs, flags, at, e = _shared_runs(t)
    size = np.diff(at)
    c = _classes_of(e["id"], classes)
    order = np.argsort(c, kind="stable")
    rows = []
    for a, b in zip(*(lambda cut: (cut[:-1], cut[1:]))(runs(c[order]))):
        own = order[a:b]
        where = np.concatenate([np.arange(at[i], at[i + 1]) for i in own])
        rows.append((int(c[own[0]]), e[own].tobytes(), size[own].astype("<i4").tobytes(), keys[where].astype("<u8").tobytes(), costs[where].astype("<i4").tobytes(), flags[where].astype("u1").tobytes()))
    kinds = [pa.int32(), *[pa.binary()] * 5]
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [f.split()[0] for f in _SHARED.split(", ")])


def choose(n: int, u: int, b: int, low: bool, keys, costs, flags) -> np.ndarray:
    """Flags of a set's shared keys after allocation: which ones it probes, and whether it can be found by them.

    It needs ``needed`` of its u non-empty segments; those that nobody shares count as tried. Of the rest it leaves out
    the costliest. With too few segments every key counts, and subsets short of one shingle are probed as well.
    """
    short = (flags & _SHORT) > 0
    need = int(needed(n, b, low))
    out = flags & (_LOW | _SHORT)
    whole = np.flatnonzero(~short)
    spare = u - need
    if spare < 0:
        if b > TINY:
            raise ValueError(f"a set of {n} shingles fell into {u} segments of band {b}; {need} are needed")
        out |= _PROBE
    elif len(whole) > spare:
        order = whole[np.lexsort((keys[whole], costs[whole]))]
        out[order[: len(order) - spare]] |= _PROBE
    # A set of n differs from a linked larger one in at most n / 3 shingles, so at most so many of its segments miss, and
    # the cheapest common segment is among its n / 3 + 1 cheapest. All sets rank segments alike, by cost and key.
    if not low and b <= TINY:
        out |= _INDEX
    elif not low and len(whole) >= u - n // 3:
        order = whole[np.lexsort((keys[whole], costs[whole]))]
        out[order[: len(order) - (u - n // 3 - 1)]] |= _INDEX
    return out


def _select(t: pa.Table, buckets: int) -> pa.Table:
    """Allocation for all sets of a class; the keys that probe or are indexed, in blocks by bucket."""
    of = lambda c, kind: np.concatenate([np.zeros(0, kind), *[np.frombuffer(x, kind) for x in t.column(c).to_pylist()]])
    e, keys, costs, flags = of("entries", _ENTRY), of("keys", "<u8"), of("costs", "<i4"), of("flags", "u1")
    owner = np.repeat(np.arange(len(e)), of("sizes", "<i4"))
    role, at = np.unique(e, return_inverse=True)
    order = np.lexsort((keys, at[owner]))
    keys, costs, flags, owner = keys[order], costs[order], flags[order], at[owner][order]
    cut, chunk, out = runs(owner), _Chunk(), []
    for a, b in zip(cut[:-1], cut[1:]):
        r = role[owner[a]]
        own, first = np.unique(keys[a:b], return_index=True)
        f = choose(int(r["n"]), int(r["u"]), int(r["b"]), bool(r["low"]), own, costs[a:b][first], flags[a:b][first])
        on = (f & (_PROBE | _INDEX)) > 0
        if on.any():
            chunk.add(own[on], np.zeros(on.sum(), np.int64), f[on], role[owner[a] : owner[a] + 1])
        if chunk.full():
            out.append(chunk.blocks(buckets))
    if chunk.size:
        out.append(chunk.blocks(buckets))
    empty = pa.RecordBatch.from_arrays([pa.array([], k) for k in (pa.int32(), *[pa.binary()] * 4)], ["bucket", "keys", "entry", "flags", "entries"])
    return pa.Table.from_batches(out or [empty])


_FOUND = "a long, b long, hits int"


def _candidates(t: pa.Table) -> pa.Table:
    """Pairs (a < b, with how many keys found them); of groups above SMALL_GROUP only pairs with the smallest set, and rows
    (smallest, member, null) of all members."""
    keys, flags, entry, entries = _read_blocks(t)
    ids, n = entries["id"][entry], entries["n"][entry].astype(np.int64)
    order = np.lexsort((ids, keys))
    keys, flags, ids, n = keys[order], flags[order], ids[order], n[order]
    at = runs(keys)
    pairs, members = [], []
    for s, e in zip(at[:-1], at[1:]):
        i = ids[s:e]
        if i[0] == i[-1]:
            continue
        # A set may stand here in two roles.
        cut = runs(i)
        f = np.bitwise_or.reduceat(flags[s:e], cut[:-1])
        i, m = i[cut[:-1]], n[s:e][cut[:-1]]
        probes, indexed = (f & _PROBE) > 0, (f & _INDEX) > 0
        if not probes.any() or not indexed.any():
            continue
        large = len(i) > SMALL_GROUP
        for first in range(1 if large else len(i) - 1):
            o = slice(first + 1, None)
            ok = (4 * np.minimum(m[first], m[o]) >= 3 * np.maximum(m[first], m[o])) & (probes[first] & indexed[o] | indexed[first] & probes[o] | large)
            pairs.append(np.stack([np.full(ok.sum(), i[first]), i[o][ok]], 1))
        if large:
            members.append(np.stack([np.full(len(i), i[0]), i], 1))
    none = np.zeros((0, 2), np.int64)
    p, hits = np.unique(np.concatenate([none, *pairs]), axis=0, return_counts=True)
    g = np.unique(np.concatenate([none, *members]), axis=0)
    both = np.concatenate([p, g])
    hits = pa.array(np.concatenate([hits, np.zeros(len(g), np.int64)]).astype(np.int32), mask=np.arange(len(both)) >= len(p))
    return pa.table({"a": both[:, 0].copy(), "b": both[:, 1].copy(), "hits": hits})


_PACKED = "leader long, rest boolean, block long, ids binary, comps binary, bounds binary, hashes binary"


def _pack(t: pa.Table, k: int) -> pa.Table:
    """The sets of one block in one row."""
    hashes, size = [], []
    for _, _, h, at in shingle_sets(t.column("text"), k):
        hashes.append(h)
        size.append(np.diff(at))
    bounds = np.concatenate([[0], np.cumsum(np.concatenate(size))])
    blob = lambda x, kind: pa.array([np.ascontiguousarray(x).astype(kind).tobytes()], pa.binary())
    one = lambda c: t.column(c)[:1].combine_chunks()
    return pa.table({"leader": one("leader"), "rest": one("rest"), "block": one("block"), "ids": blob(t.column("id").to_numpy(), "<i8"), "comps": blob(t.column("comp").to_numpy(), "<i8"), "bounds": blob(bounds, "<i8"), "hashes": blob(np.concatenate(hashes), "<u8")})


def common_counts(h1, b1, h2, b2) -> np.ndarray:
    """Sizes of all intersections of two lists of sets (hashes and bounds): products of their incidence matrices."""
    both = np.intersect1d(h1, h2)
    out = np.zeros((len(b1) - 1, len(b2) - 1), np.float64)
    places = []
    for h, b in ((h1, b1), (h2, b2)):
        at = np.minimum(np.searchsorted(both, h), max(0, len(both) - 1))
        on = both[at] == h if len(both) else np.zeros(len(h), bool)
        row, col = np.repeat(np.arange(len(b) - 1), np.diff(b))[on], at[on]
        order = np.argsort(col, kind="stable")
        places.append((row[order], col[order], len(b) - 1))
    for first in range(0, len(both), TILE_SHINGLES):
        sides = []
        for row, col, n in places:
            s = slice(*np.searchsorted(col, [first, first + TILE_SHINGLES]))
            m = np.zeros((n, min(TILE_SHINGLES, len(both) - first)), np.float32)
            m[row[s], col[s] - first] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def _tile_links(batches):
    """Of each tile, links a < b that join sets of different components: a forest of them, no more than there are sets."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            (i1, c1, b1, h1), (i2, c2, b2, h2) = ([np.frombuffer(r[f"{side}_{c}"], t) for c, t in (("ids", "<i8"), ("comps", "<i8"), ("bounds", "<i8"), ("hashes", "<u8"))] for side in ("x", "y"))
            both = common_counts(h1, b1, h2, b2)
            size = np.diff(b1)[:, None] + np.diff(b2)[None, :]
            root: dict[int, int] = {}

            def find(c, root=root):
                while root.get(c, c) != c:
                    c = root[c]
                return c

            for x, y in zip(*np.nonzero((4 * both >= 3 * (size - both)) & (c1[:, None] != c2[None, :]))):
                p, q = find(int(c1[x])), find(int(c2[y]))
                if p != q:
                    root[max(p, q)] = min(p, q)
                    out.append((min(int(i1[x]), int(i2[y])), max(int(i1[x]), int(i2[y]))))
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])


def _similar(batches, k: int, num: int, den: int):
    """Pairs whose whole sets reach the similarity num / den."""
    for batch in batches:
        # Neighbouring pairs often share a text.
        sides = []
        for c in (2, 3):
            out = []
            for _, _, h, at in shingle_sets(batch.column(c), k):
                out += [h[a:b] for a, b in zip(at[:-1], at[1:])]
            sides.append(out)
        both = np.array([len(np.intersect1d(x, y, True)) for x, y in zip(*sides)], np.int64)
        size = np.array([len(x) + len(y) for x, y in zip(*sides)], np.int64)
        ok = pa.array(den * both >= num * (size - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ok], ["a", "b", "linked"])


class JaccardJoin:
    """Links of similarity 3/4 or more between the texts of ``documents`` and their components."""

    def __init__(self, documents: DataFrame, k: int = K):
        self.k, self.spark = k, documents.sparkSession
        self.scratch = Scratch(self.spark, "jaccard")
        self.docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.xxhash64("text").alias("text_hash"))
        s = self.scratch
        #: One row per document.
        self.sets = s.save(self.docs.mapInArrow(lambda b: _sets(b, k), "doc_id long, text_hash long, n long, k1 long, k2 long"), "sets")
        known = self.sets.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
        #: Equal sets are one class with a number of its own; its leader is the row of smallest id (and text hash).
        led = known.groupBy("n", "k1", "k2").agg(F.min(F.struct("doc_id", "text_hash")).alias("led"))
        self.classes = s.save(led.select("n", "k1", "k2", F.col("led.doc_id").alias("rep"), F.col("led.text_hash").alias("text_hash"), F.monotonically_increasing_id().alias("class")), "classes")

    def texts(self, classes: DataFrame | None = None) -> DataFrame:
        """doc_id (the class's number), text of the leaders of the classes, or of those that are rows of ``classes``.

        Leaders are found by id and text hash: an id that repeats with different texts leads several classes. A repeated row
        is repeated here as well."""
        own = self.classes if classes is None else self.classes.join(classes.select(F.col("doc_id").alias("class")), "class", "left_semi")
        own = own.select(F.col("rep").alias("doc_id"), "text_hash", "class")
        return self.docs.join(own, ["doc_id", "text_hash"]).select(F.col("class").alias("doc_id"), "text")

    def candidates(self) -> tuple[DataFrame, DataFrame]:
        """(pairs a, b, hits) and (leader, id) of the members of large groups, by their smallest members."""
        s, k, buckets = self.scratch, self.k, bucket_count(self.docs)
        first, resplit = first_buckets(buckets), lambda b: _resplit(b, buckets)
        coarse = dealt(self.texts().mapInArrow(lambda b: _emit(b, k, first, COARSE), _BLOCKS), buckets, resplit)
        counted = coarse.groupBy("bucket").applyInArrow(lambda t: _counted(t, buckets), _COUNTED)
        some = s.save(counted.groupBy("cls").applyInArrow(_may_link, "doc_id long"), "some")
        #: Texts of the sets that may have links.
        self.held = s.save(self.texts(some).dropDuplicates(["doc_id"]), "held")
        fine = dealt(self.held.mapInArrow(lambda b: _emit(b, k, first, FINE), _BLOCKS), buckets, resplit)
        shared = fine.groupBy("bucket").applyInArrow(lambda t: _shared(t, buckets), _SHARED)
        chosen = shared.groupBy("cls").applyInArrow(lambda t: _select(t, buckets), _BLOCKS)
        found = s.save(chosen.groupBy("bucket").applyInArrow(_candidates, _FOUND), "found")
        pairs = found.where("hits IS NOT NULL").groupBy("a", "b").agg(F.sum("hits").alias("hits"))
        members = found.where("hits IS NULL").select(F.col("a").alias("leader"), F.col("b").alias("id")).distinct()
        return s.save(pairs, "pairs"), s.save(members, "members")

    def open_groups(self, members: DataFrame) -> DataFrame:
        """Links a-b between components that large groups still hold, compared in tiles of blocks."""
        s, k = self.scratch, self.k
        m = members.join(self._comp.select(F.col("node").alias("id"), "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        m = s.save(m, "grouped")
        parts = m.groupBy("leader", "comp").agg(F.count("*").alias("c"))
        groups = parts.groupBy("leader").agg(F.count("*").alias("parts"), F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max("c").alias("n_main"), F.sum("c").alias("n")).where("parts > 1")
        groups = s.save(groups, "groups")
        m = m.join(groups, "leader").withColumn("rest", F.col("comp") != F.col("main"))
        of = F.when(F.col("rest"), F.col("n") - F.col("n_main")).otherwise(F.col("n_main"))
        m = m.withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(of / BLOCK_SETS)))
        m = m.select("leader", "rest", "block", "id", "comp").join(self.held.select(F.col("doc_id").alias("id"), "text"), "id")
        packed = s.save(m.groupBy("leader", "rest", "block").applyInArrow(lambda t: _pack(t, k), _PACKED), "packed", batch_rows=BLOCK_SETS)
        side = lambda df, p: df.select("leader", *[F.col(c).alias(f"{p}_{c}") for c in ("rest", "block", "ids", "comps", "bounds", "hashes")])
        tiles = side(packed.where("rest"), "x").join(side(packed, "y"), "leader").where("NOT y_rest OR y_block >= x_block")
        return s.save(tiles.mapInArrow(_tile_links, "a long, b long"), "joined", batch_rows=4)

    def verify(self, pairs: DataFrame, texts: DataFrame, tag: str) -> DataFrame:
        """a, b, linked of the pairs, by their whole sets."""
        k, t = self.k, texts.select("doc_id", "text")
        both = pairs.select("a", "b").join(t.toDF("a", "ta"), "a").join(t.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
        return self.scratch.save(both.mapInArrow(lambda x: _similar(x, k, 3, 4), "a long, b long, linked boolean"), tag, batch_rows=500)

    def links(self) -> tuple[DataFrame, DataFrame]:
        """(node, comp) of all classes that have links, and verified links a-b between classes that show it: a spanning set, as
        pairs within a component that is already known are not compared."""
        s = self.scratch
        pairs, members = self.candidates()
        texts = self.held
        comp = lambda df, c: df.join(self._comp.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}")), c, "left").withColumn(f"c{c}", F.coalesce(f"c{c}", c))
        open_ = lambda df: comp(comp(df, "a"), "b").where("ca <> cb")
        # First each set with the partner that most keys point to, then what is still open between components.
        best = pairs.groupBy("b").agg(F.max_by("a", F.struct("hits", -F.col("a"))).alias("a")).select("a", "b")
        done = self.verify(best, texts, "verified-1")
        self._comp = components(s, done.where("linked"), "cc1")
        rest = open_(pairs.join(done, ["a", "b"], "left_anti"))
        done2 = self.verify(rest, texts, "verified-2")
        linked = done.where("linked").unionByName(done2.where("linked"))
        self._comp = components(s, linked, "cc2")
        # Large groups were only compared with their smallest member.
        more = self.open_groups(members)
        linked = linked.select("a", "b").unionByName(more)
        self._comp = components(s, linked, "cc3")
        return self._comp, linked.select("a", "b")

    def result(self) -> DataFrame:
        """doc_id, n_shingles, component_id, class_id of every row."""
        found, _ = self.links()
        # The least class number of a component stands for it until here; its smallest document id is the result.
        nodes = self.classes.select("n", "k1", "k2", "rep", "text_hash", "class").join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("comp", F.coalesce("comp", "class"))
        nodes = self.scratch.save(nodes, "nodes")
        least = nodes.groupBy("comp").agg(F.min(F.struct("rep", "text_hash")).alias("least")).select("comp", F.col("least.rep").alias("component_id"), F.col("least.text_hash").alias("least_hash"))
        led = self.scratch.save(nodes.join(least, "comp").select("n", "k1", "k2", F.col("rep").alias("class_id"), "component_id", "least_hash"), "led")
        # Only ``sets`` and ``led`` are read from here on.
        self.scratch.drop("classes", "some", "held", "found", "pairs", "members", "verified-1", "verified-2", "grouped", "groups", "packed", "joined", "nodes")
        rows = self.sets.join(led, ["n", "k1", "k2"], "left")
        of = lambda c: F.when(F.col("doc_id").isNotNull(), F.coalesce(c, "doc_id")).alias(c)
        leads = F.coalesce((F.col("doc_id") == F.col("component_id")) & (F.col("text_hash") == F.col("least_hash")), F.lit(True))
        return rows.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), of("component_id"), of("class_id"), leads.alias("leads"))


def jaccard_components(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, class_id, leads of every row: sets of distinct 5-word shingles (A-Z
    lower-cased; fewer words are one shingle) link at a Jaccard similarity of 0.75 or more; component_id is the smallest id
    reachable, class_id the smallest with the same set, text_hash Spark's xxhash64 of the text. leads says whether a row has
    the smallest id and text hash of its component (a row that repeats both leads as well, as does one without words or id).

    Null, empty and wordless texts have no shingles and link with nothing. Rows with a null id take no part and have a null
    component. Rows that repeat an id with different texts are told apart: each is compared, and has the component of its own
    text. Other columns are not read; an empty table gives an empty result.
    """
    return JaccardJoin(documents).result()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


#: Sets by their sorted shingles as text, all pairs that share a shingle, and reachability.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) AS t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS h FROM s GROUP BY doc_id),
c AS (SELECT h, any_value(n) AS n, min(doc_id) AS rep FROM n GROUP BY h),
u AS (SELECT g, doc_id AS rep FROM s WHERE doc_id IN (SELECT rep FROM c)),
p AS (SELECT x.rep AS a, y.rep AS b, count(*) AS m FROM u x JOIN u y ON x.g = y.g AND x.rep < y.rep GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN c ca ON ca.rep = a JOIN c cb ON cb.rep = b WHERE 100 * m >= 75 * (ca.n + cb.n - m)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
k AS (SELECT node, min(seen) AS comp FROM r GROUP BY node)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(k.comp, c.rep, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (h) LEFT JOIN k ON k.node = c.rep
"""
