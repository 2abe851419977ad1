import json
import random
import zlib

import numpy as np
import pytest

from extentlake.llm import _tokens, packing
from extentlake.llm.packing import CAPACITY, Island, Tokens, best_fit, lower_bound, pack, tokenizer_path

SCHEMA = "doc_id long, text string, piece string, block int"


@pytest.fixture(scope="module")
def tokens():
    return Tokens(tokenizer_path())


def test_ids_are_those_of_the_tokenizer(tokens):
    rnd = random.Random(0)
    texts = ["", " ", "a\tb  c\n\nd", "It's. İstanbul ŉa Ünï, ΑΣ. x<|endoftext|>y. é ́ ...,. A,B. 12.", "日本。ſ. ǅ, ª. º \x1c q"]
    texts += ["".join(rnd.choice("aB.,' \n1é́İ<|>endoftx Σς‍") for _ in range(60)) for _ in range(2000)]
    want = [e.ids for e in tokens.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [g.tolist() for g in tokens.encode(texts)] == want
    tokens.clear()
    assert [g.tolist() for g in tokens.encode(texts[:9])] == want[:9]


def test_words_never_seen_cost_no_call_of_the_tokenizer(tokens):
    """Invented words are most of what tokenising costs: all of them are merged at once."""
    rnd = random.Random(5)
    texts = [" ".join("".join(rnd.choice("aBcdeéÜo") for _ in range(rnd.randint(1, 14))) + rnd.choice(["", ",", ".", "###", "'s", "'Re!", "12", "²"]) for _ in range(200)) for _ in range(20)]
    want = [e.ids for e in tokens.tokenizer.encode_batch(texts, add_special_tokens=False)]
    alone = Tokens(tokenizer_path())
    alone.tokenizer = None
    assert [g.tolist() for g in alone.encode(texts)] == want


def test_words_are_split_and_merged_as_by_the_tokenizer(tokens, monkeypatch):
    monkeypatch.setattr(_tokens, "STEP", 7)
    monkeypatch.setattr(_tokens, "DISTINCT", 5)
    rnd = random.Random(6)
    some = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    texts = [some([chr(c) for c in range(0x300)], 40) for _ in range(300)]
    texts += [some("aB'sStTreVElLdm\"12 \n.,é²İ<|ñ", 60) for _ in range(300)]
    texts += [some("thingsandofe", rnd.randint(1, 90)) for _ in range(300)]
    texts += ["x" * 64 + " " + "y" * 65 + " " + "é" * 32 + " " + "é" * 33 + "'s", "'", "''s 's's a' 'll'l", "a<|startoftext|>b <|endoftext|>", "", " ", "\n", "日" * 30 + " 日"]
    want = [e.ids for e in tokens.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [g.tolist() for g in tokens.encode(texts)] == want
    assert tokens.encode([]) == []


def test_another_tokenizer_encodes_whole_texts(tokens, tmp_path):
    spec = json.loads(tokens.tokenizer.to_str())
    spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"\p{L}+ ?|\p{N}+|[^\p{L}\p{N}]+"
    (tmp_path / "other.json").write_text(json.dumps(spec))
    other, texts = Tokens(str(tmp_path / "other.json")), ["two words, 123", "", "x\ny"]
    want = [e.ids for e in other.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [g.tolist() for g in other.encode(texts)] == want != [g.tolist() for g in tokens.encode(texts)]


def check(rows, docs, tokens):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= CAPACITY
    for d, t in docs:
        ids = np.append(tokens.encode([t or ""])[0], 1).astype("<u4")
        if sum(x == d for x, _ in docs) == 1:
            got = sorted(by_doc[d], key=lambda r: r.piece)
            assert [(r.piece, r.start, r.length, r.ids_crc32) for r in got] == [(k, k * CAPACITY, len(x), zlib.crc32(x.tobytes())) for k, x in enumerate(ids[a : a + CAPACITY] for a in range(0, len(ids), CAPACITY))]
    return len(by_seq)


def test_pieces_sequences_and_few_bins(spark, tokens, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ITEMS", 100)
    rnd = random.Random(2)
    docs = [(k, " ".join(rnd.choice(["word", "xq", "Zed,"]) for _ in range(int(rnd.paretovariate(0.6) * 20) % 9000))) for k in range(400)]
    docs += [(1000, None), (1001, ""), (1002, "a " * 20_000), (None, "null id"), (7, "again"), (7, "again")]
    rows = pack(spark.createDataFrame([(*d, "clash", 1) for d in docs], SCHEMA)).collect()
    n = check(rows, docs, tokens)
    size = [r.length for r in rows]
    assert n <= lower_bound(size, CAPACITY) * 1.02 + 2


def test_crossover_decides_a_block_that_best_fit_fails(spark, tokens):
    """Documents of three lengths that fill sequences exactly in threes: the algorithm needs fewer sequences than best fit."""
    rng = np.random.default_rng(17)
    size = [x for _ in range(12) for a in rng.integers(1100, 1900, 1).tolist() for b in [int(rng.integers(1050, 4096 - 1050 - a))] for x in (a, b, 4096 - a - b)]
    docs = [(k, " ".join(["a"] * (n - 1))) for k, n in enumerate(size)]
    rows = pack(spark.createDataFrame([(*d, "clash", 1) for d in docs], SCHEMA)).collect()
    assert sorted(r.length for r in rows) == sorted(size)
    n, base = check(rows, docs, tokens), len(Island(size, CAPACITY, 0).first().bins)
    assert 12 <= n < base and {r.gain for r in rows} == {base - n}


def fewest_bins(size, capacity):
    """By trying all: the next item goes into each open bin or a new one."""
    best = [len(size)]

    def go(k, fill):
        if len(fill) >= best[0]:
            return
        if k == len(size):
            best[0] = len(fill)
            return
        for b in range(len(fill)):
            if fill[b] + size[k] <= capacity:
                go(k + 1, [*fill[:b], fill[b] + size[k], *fill[b + 1 :]])
        go(k + 1, [*fill, size[k]])

    go(0, [])
    return best[0]


def test_small_packings_are_the_best_there_are():
    rng = np.random.default_rng(6)
    for seed in range(30):
        size = sorted(rng.integers(10, 60, rng.integers(1, 9)).tolist(), reverse=True)
        island = Island(size, 100, seed)
        assert len(island.evolve([island.first()], population=6, generations=40)[0].bins) == fewest_bins(size, 100)


def test_an_island_crosses_even_if_best_fit_is_perfect(monkeypatch):
    crossed = []
    monkeypatch.setattr(Island, "cross", lambda self, a, b, real=Island.cross: crossed.append(1) or real(self, a, b))
    island = Island([50] * 40, 100, 0)
    assert len(island.evolve([island.first()])[0].bins) == 20 and crossed


def test_no_row(spark):
    assert pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_best_fit_takes_the_fullest_bin():
    bins, fill = [[0], [1]], [5, 7]
    best_fit([2, 3], [5, 7, 3, 9], bins, fill, 10)
    assert bins == [[0], [1, 2], [3]] and fill == [5, 10, 9]


def test_the_genetic_algorithm_keeps_items_and_beats_best_fit():
    """Triplets that fill a bin exactly, on which best fit is far from the best."""
    rng = np.random.default_rng(4)
    better = 0
    for seed in range(4):
        size = [int(x) for _ in range(20) for a in rng.integers(260, 480, 1) for b in [int(rng.integers(250, 750 - a))] for x in (a, b, 1000 - a - b)]
        island = Island(size, 1000, seed)
        first = island.first()
        best = island.evolve([first], population=10, generations=300)[0]
        assert sorted(i for b in best.bins for i in b) == list(range(60))
        assert all(sum(size[i] for i in b) == f <= 1000 for b, f in zip(best.bins, best.fill))
        assert best.cost <= first.cost
        better += len(best.bins) < len(first.bins)
        child = island.cross(first, best)
        assert sorted(i for b in child.bins for i in b) == list(range(60))
    assert better
