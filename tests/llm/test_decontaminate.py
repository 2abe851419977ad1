import random
import re

import numpy as np
import pytest

from extentlake.llm import _words
from extentlake.llm.decontaminate import contaminated, tiles

DOCS, ITEMS = "doc_id long, text string, item_id string", "item_id long, text string, doc_id string"


def words(rnd, n):
    return [f"w{rnd.randrange(10**6)}" for _ in range(n)]


def run(spark, docs, items, **more):
    d, i = spark.createDataFrame([(*x, "clash") for x in docs], DOCS), spark.createDataFrame([(*x, "clash") for x in items], ITEMS)
    return sorted(((r.doc_id, r.item_id, r.item_words, r.covered_words, r.tiles, r.longest_tile) for r in contaminated(d, i, **more).collect()), key=str)


@pytest.mark.parametrize("limit", [10**7, 0])
def test_exact_reordered_and_clean(spark, limit):
    """Both joins: with the benchmark sent to all tasks, and by a shuffle of seeds."""
    rnd = random.Random(1)
    item = [words(rnd, 8) for _ in range(4)]
    text = ". ".join(" ".join(s) for s in item)
    moved = "! ".join(" ".join(s).upper() for s in reversed(item))
    noise = lambda n: " ".join(words(rnd, n))
    docs = [(1, f"{noise(30)} {text} {noise(9)}"), (2, f"{noise(5)} {moved}"), (3, f"{noise(50)} {' '.join(item[0])}"), (4, noise(200)), (5, None), (6, ""), (7, text), (7, text), (None, text), (8, f"{noise(40_000)} {text}")]
    items = [(10, text), (11, text), (12, "too few words"), (13, None), (14, "")]
    want = [(d, i, 32, 32, n, longest) for d, n, longest in [(1, 1, 32), (2, 4, 8), (7, 1, 32), (7, 1, 32), (None, 1, 32), (8, 1, 32)] for i in (10, 11)]
    assert run(spark, docs, items, broadcast_bytes=limit) == sorted(want, key=str)


@pytest.mark.parametrize("limit", [10**7, 0])
def test_empty_sides(spark, limit):
    assert run(spark, [], [(1, "a b c d e f")], broadcast_bytes=limit) == [] and run(spark, [(1, "a b c d e f")], [], broadcast_bytes=limit) == []


@pytest.mark.parametrize("limit", [10**7, 0])
def test_reordered_item_of_short_sentences(spark, limit):
    """Sentences of 3, 2, 4 and 7 words, taken apart: only the last holds five words in a row. An item of four words."""
    rnd = random.Random(6)
    item = [words(rnd, n) for n in (3, 2, 4, 7)]
    apart = " ".join(" ".join([*words(rnd, 6), *s]) for s in reversed(item))
    short = " ".join(words(rnd, 4))
    items = [(10, ". ".join(" ".join(s) for s in item)), (11, short)]
    got = run(spark, [(1, apart), (2, " ".join(words(rnd, 60))), (3, f"a {short} b"), (4, " ".join(item[3]))], items, broadcast_bytes=limit)
    assert got == [(1, 10, 16, 14, 3, 7), (3, 11, 4, 4, 1, 4)]


@pytest.mark.parametrize("limit", [10**7, 0])
def test_items_of_fewer_words_than_a_tile(spark, limit):
    """They are found where they are all of a document, and nowhere else."""
    docs = [(1, "Yes!"), (2, "yes, sir"), (3, "yes sir and more words"), (4, "no"), (5, "...")]
    assert run(spark, docs, [(10, "yes"), (11, "Yes sir."), (12, "!")], broadcast_bytes=limit) == [(1, 10, 1, 1, 1, 1), (2, 11, 2, 2, 1, 2)]


def brute_pairs(docs, items, k, share):
    split = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    out = []
    for d, text in docs:
        for i, item in items:
            a, b = split(item), split(text)
            got = brute_tiles(a, b, k) if len(a) >= k else [(0, 0, len(a))] if a and a == b else []
            if got and sum(t[2] for t in got) >= share * len(a):
                out.append((d, i, len(a), sum(t[2] for t in got), len(got), got[0][2]))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [10**7, 0])
def test_pairs_equal_brute_force(spark, limit, sized):
    """The whole operator on texts of few words, which share many seeds; also with texts in parts."""
    if limit:
        sized(_words, "SLICE_BYTES", 90)
    rnd = random.Random(12)
    text = lambda n: " ".join(rnd.choice(["ab", "c,", "é", "D.", "x1", "yy", "zz!", "q"]) for _ in range(n))
    items = [(k, text(rnd.choice([1, 2, 3, 5, 9, 20]))) for k in range(15)] + [(99, None), (98, "")]
    docs = [(k, " ".join([text(rnd.randrange(6)), *(x or "" for _, x in rnd.sample(items, 2)), text(rnd.randrange(6))])) for k in range(40)] + [(50, None), (51, items[0][1])]
    assert run(spark, docs, items, broadcast_bytes=limit) == brute_pairs(docs, items, 3, 0.5)


def brute_tiles(a, b, k):
    ma, mb, out = [False] * len(a), [False] * len(b), []
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not ma[i + n] and not mb[j + n]:
                    n += 1
                if n >= k and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return out
        i, j, n = best
        ma[i : i + n] = [True] * n
        mb[j : j + n] = [True] * n
        out.append(best)


def test_tiling_equals_the_quadratic_algorithm():
    rnd = np.random.default_rng(2)
    for _ in range(150):
        a, b, k = rnd.integers(0, 3, rnd.integers(3, 25)), rnd.integers(0, 3, rnd.integers(3, 30)), int(rnd.integers(2, 4))
        seeds = [(i, j) for i in range(len(a) - k + 1) for j in range(len(b) - k + 1) if (a[i : i + k] == b[j : j + k]).all()]
        s = np.array(seeds, np.int64).reshape(-1, 2)
        assert tiles(a, b, s[:, 0], s[:, 1], k) == brute_tiles(a.tolist(), b.tolist(), k)
