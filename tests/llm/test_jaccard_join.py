import random

import numpy as np
import pytest

from extentlake.llm import _buckets, _words
from extentlake.llm import jaccard_join as jj
from extentlake.llm._graph import components as graph_components
from extentlake.llm._common import Scratch

from .brute import components, shingles

SCHEMA = "doc_id long, text string, n int, rep string"


def run(spark, docs):
    return jj.jaccard_components(spark.createDataFrame([(*d, 1, "clash") for d in docs], SCHEMA).repartition(5)).collect()


def edited(rnd, words, share):
    out = list(words)
    for _ in range(int(len(out) * share) + (rnd.random() < 0.5)):
        if out:
            k = rnd.randrange(len(out))
            out[k : k + 1] = rnd.choice([[], [out[k], str(rnd.random())], [str(rnd.random())]])
    return out


@pytest.mark.parametrize("small", [1, 3])
def test_equals_brute_force(spark, small, sized):
    """Families of copies and near copies of all sizes, a hot passage, and chains of edits; for small=1 also texts and
    sets in parts and keys by way of a few first buckets."""
    if small == 1:
        sized(_words, "SLICE_BYTES", 150)
        sized(jj, "LARGE_SET", 30)
        sized(_buckets, "FIRST_BUCKETS", 3)
        sized(_buckets, "BUCKET_TEXT_BYTES", 2000)
    sized(jj, "SMALL_GROUP", small)
    sized(jj, "CHUNK_KEYS", 2000)
    rnd = random.Random(8)
    hot = [f"h{k}" for k in range(25)]
    docs = []
    for family in range(45):
        base = [str(rnd.randrange(10**6)) for _ in range(rnd.choice([1, 2, 4, 5, 6, 7, 8, 9, 11, 14, 20, 40, 90, 200]))]
        if family % 3 == 0:
            base = base[: len(base) // 2] + hot + base[len(base) // 2 :]
        for _ in range(rnd.choice([1, 2, 3, 9])):
            docs.append((len(docs) * 3 % 1009, " ".join(w.upper() if rnd.random() < 0.1 else w for w in base)))
            base = edited(rnd, base, rnd.choice([0, 0.01, 0.03, 0.06]))
    docs += [(2000, None), (2001, ""), (2002, " \n"), (2003, "one two"), (2004, "ONE  two"), (2005, "one two three")]
    want = components(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, docs)}
    assert got == want
    assert len({c for _, c in want.values()}) < len(docs) - 20


def test_nulls_repeats_and_empty(spark):
    t = "a b c d e f g h"
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in run(spark, [(1, t), (1, t), (None, t), (None, None), (5, t), (3, "x")])), key=str)
    assert got == sorted([(1, 4, 1), (1, 4, 1), (None, 4, None), (None, 0, None), (5, 4, 1), (3, 1, 3)], key=str)
    assert run(spark, []) == []


def test_an_id_with_several_texts(spark):
    """Each text of the id is compared; the id alone doesn't link them."""
    rnd = random.Random(2)
    long, other = ([f"w{rnd.randrange(10**6)}" for _ in range(n)] for n in (100, 20))
    near, near_other = [*long[:-1], "edit"], [*other, "more"]
    docs = [(1, " ".join(long)), (1, " ".join(other)), (5, " ".join(near)), (7, " ".join(near_other)), (1, " ".join(long))]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.leads) for r in run(spark, docs))
    assert got == sorted([(1, 96, 1, True), (1, 96, 1, True), (1, 16, 1, True), (5, 96, 1, False), (7, 17, 1, False)])


def test_a_very_long_text(spark):
    rnd = random.Random(1)
    words = [str(rnd.randrange(10**9)) for _ in range(120_000)]
    near = words[:50_000] + ["edit"] + words[50_001:]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, [(4, " ".join(words)), (2, " ".join(near)), (9, " ".join(words[:60_000]))])}
    assert got == {4: (len(shingles(" ".join(words))), 2), 2: (len(shingles(" ".join(near))), 2), 9: (59_996, 9)}


def test_linked_sets_differ_in_fewer_segments_than_are_needed():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        for low in (False, True):
            b = int(jj.band(n)) - low
            if b < 0 or low and 3 * n > 4 * 2**b:
                continue
            smallest, largest = -(-3 * n // 4), min(n, 2**b)
            assert all((n + m) // 7 < jj.needed(n, b, low) for m in range(smallest, largest + 1))


def test_components_of_paths_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(1, k) for k in range(2, 30)] + [(500, 501), (501, 502), (502, 500), (7, 7)]
    got = {r.node: r.comp for r in graph_components(Scratch(spark, "test"), spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, **{k: 1 for k in range(1, 30)}, **{k: 500 for k in (500, 501, 502)}}


def test_tiles_count_all_intersections(sized):
    sized(jj, "TILE_SHINGLES", 7)
    rng = np.random.default_rng(5)
    for _ in range(20):
        sets = [[np.unique(rng.integers(0, 60, rng.integers(0, 40))).astype(np.uint64) for _ in range(rng.integers(1, 6))] for _ in range(2)]
        flat = [(np.concatenate(x), np.concatenate([[0], np.cumsum([len(y) for y in x])])) for x in sets]
        assert jj.common_counts(*flat[0], *flat[1]).tolist() == [[len(np.intersect1d(a, b)) for b in sets[1]] for a in sets[0]]
