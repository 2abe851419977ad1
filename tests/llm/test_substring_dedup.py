import random

import pytest

from extentlake.llm import _buckets, _words, substring_dedup
from extentlake.llm.substring_dedup import deduplicate

from .brute import WORD, kept_words

SCHEMA = "doc_id long, text string, spans string, hits int"


def run(spark, docs, width):
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in docs], SCHEMA).repartition(5)
    return deduplicate(df, width).collect()


def thue_morse(n):
    """Two words that polynomials modulo 2^64 can't tell apart, whatever their base."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_of_one_pattern_and_its_complement_differ(spark):
    a, b = thue_morse(1024)
    common = [f"w{k}" for k in range(49)]
    got = {r.doc_id: r.kept for r in run(spark, [(1, " ".join([*common, a])), (2, " ".join([*common, b]))], 50)}
    assert len(got[2].split()) == 50


def test_repeats_across_parts_of_a_long_text(spark, sized):
    """Spans that begin in one part of a long text and end in another; huge words."""
    sized(_words, "SLICE_BYTES", 200)
    rnd = random.Random(9)
    base = [f"{rnd.randrange(50)}" for _ in range(600)]
    docs = [(1, " ".join(base)), (2, " ".join(["x", *base[100:420], "y", *base[3:90]])), (3, "q" * 5000 + " " + " ".join(base[:300])), (4, " ".join(base[10:14])), (5, "q" * 5000)]
    want = kept_words(docs, 9)
    for d, r in ((r.doc_id, r) for r in run(spark, docs, 9)):
        assert r.kept == " ".join(want[d]), d
        assert all(b < c for (_, b), (c, _) in zip(r.spans, r.spans[1:]))


@pytest.mark.parametrize("first", [3, 4096])
def test_equals_brute_force(spark, sized, first):
    """Dealt into buckets at once, and by way of a few first buckets."""
    sized(_buckets, "FIRST_BUCKETS", first)
    sized(_buckets, "BUCKET_TEXT_BYTES", 500)
    sized(substring_dedup, "CHUNK", 300)
    rnd = random.Random(5)
    passages = [[rnd.choice("ab c d éß".split()) for _ in range(rnd.randint(5, 30))] for _ in range(6)]
    docs = []
    for d in range(80):
        words = [w for _ in range(rnd.randint(0, 5)) for w in (rnd.choice(passages) if rnd.random() < 0.6 else [str(rnd.random())] * rnd.randint(1, 9))]
        docs.append((d, rnd.choice([" ", "\n", "\t \x0b"]).join(words)))
    docs += [(100, None), (101, ""), (102, " \t\n"), (103, docs[3][1]), (104, docs[3][1]), (-5, docs[9][1])]
    want = kept_words(docs, 7)
    got = {r.doc_id: r for r in run(spark, docs, 7)}
    assert len(got) == len(docs)
    for d, t in docs:
        words = WORD.findall(t or "")
        assert got[d].kept == " ".join(want[d]), d
        assert got[d].n_words == len(words)
        spans = [(s.start, s.end) for s in got[d].spans]
        assert [w for i, w in enumerate(words) if not any(a <= i < b for a, b in spans)] == want[d]
        assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))  # maximal


def test_repeated_and_null_ids(spark):
    text = " ".join(map(str, range(20)))
    got = sorted(((r.doc_id, r.kept) for r in run(spark, [(1, text), (1, text), (None, text), (2, text), (2, text), (2, "own " + text)], 5)), key=str)
    assert got == sorted([(1, text), (1, text), (None, text), (2, ""), (2, ""), (2, "own")], key=str)


def test_other_columns_are_carried_and_long_texts_pass(spark):
    df = spark.createDataFrame([(1, "w " * 400_000, "a", 1), (2, "w " * 60, "b", 2)], SCHEMA)
    got = {r.doc_id: r for r in deduplicate(df.drop("spans"), 50, carry=["hits"]).collect()}
    assert got[1].n_words == 400_000 and got[1].hits == 1 and got[2].kept == ""


def test_empty(spark):
    assert run(spark, [], 50) == []
