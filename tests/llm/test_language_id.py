import random
import zlib

import numpy as np

from extentlake.llm.language_id import UNKNOWN, WINDOW, ByteTagger, identify, query, train, training_windows

SCHEMA = "doc_id long, text string, lang string, lang_pred string"


def corpus(n):
    rnd = random.Random(1)
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["zrt", "uxq", "ö"], "cc": ["the", "ing", "wh"]}
    return [(k, " ".join("".join(rnd.choices(parts[lang], k=3)) for _ in range(rnd.randint(1, 60))), lang, "x") for k, lang in zip(range(n), list(parts) * n)]


def test_gradients_are_those_of_the_loss():
    model = ByteTagger(["a", "b"], hidden=3)
    for p in model.params():
        p[...] = p.astype("f8")
    x = np.array([[65, 66, 256], [67, 65, 66]], np.int16).T
    y, mask = np.array([0, 1]), (x < 256).astype("f8")
    _, grads = model.step(x, y, mask)
    rng = np.random.default_rng(0)
    for p, g in zip(model.params(), grads):
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in p.shape) if p.ndim == 1 or len(p) != 257 else (int(rng.choice([65, 66, 67])), int(rng.integers(p.shape[1])))
            old, e = p[at], 1e-2
            p[at] = old + e
            up = model.step(x, y, mask)[0]
            p[at] = old - e
            down = model.step(x, y, mask)[0]
            p[at] = old
            assert abs((up - down) / (2 * e) - g[at]) < 2e-3


def test_held_out_accuracy_and_edge_cases(spark):
    rows = corpus(600) + [(9001, None, "aa", "x"), (9002, "123 !?", "aa", "x"), (9003, "", "bb", "x"), (None, "kalomi mikalo", None, "x"), (9004, "thewhing " * 20000, None, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = identify(docs, train(docs, sample_docs=300, epochs=6)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, *_ in rows if d is not None) and not by[None].held_out
    held = [(by[d].lang_pred, lang) for d, _, lang, _ in rows[:600] if by[d].held_out]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert [by[d].lang_pred for d in (9001, 9002, 9003)] == [UNKNOWN] * 3 and by[9001].score == 0
    assert by[9004].lang_pred == "cc" and by[None].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got)


def test_the_label_of_a_row_is_no_input(spark):
    rows = corpus(120)
    docs = spark.createDataFrame(rows, SCHEMA)
    model = train(docs, sample_docs=60, epochs=2)
    other = spark.createDataFrame([(d, t, "zz", p) for d, t, _, p in rows], SCHEMA)
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in identify(x, model).collect()} for x in (docs, other))
    assert a == b


def test_letters_are_those_of_unicode(spark):
    """Characters for numbers are no letters."""
    rows = corpus(60) + [(k, t, None, "x") for k, t in ((901, "½ ²"), (902, "Ⅷ ①"), (903, "Ⅷ a"), (904, "ß"), (905, "字"), (906, "_ 1"))]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.lang_pred for r in identify(docs, train(docs, sample_docs=30, epochs=1)).collect()}
    assert [got[k] == UNKNOWN for k in range(901, 907)] == [True, True, False, False, False, True]


def test_the_sample_is_the_same_for_rows_in_any_order(spark):
    rows = corpus(90)
    rows = [(d % 7, t, lang, p) for d, t, lang, p in rows] + rows[:5]
    a, b = (train(spark.createDataFrame(x, SCHEMA).repartition(n), sample_docs=30, epochs=1) for x, n in ((rows, 2), (rows[::-1], 5)))
    assert all((p == q).all() for p, q in zip(a.params(), b.params()))


def test_noise_is_no_language(spark):
    rnd = random.Random(5)
    junk = lambda: " ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(3, 9))) for _ in range(30))
    rows = corpus(600) + [(7000 + k, junk(), None, "x") for k in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in identify(docs, train(docs, sample_docs=300, epochs=6)).collect()}
    assert np.mean([got[7000 + k].no_language > got[7000 + k].score for k in range(20)]) > 0.9
    assert np.mean([got[k].no_language > got[k].score for k in range(600)]) < 0.01


def test_windows_cover_every_byte():
    x, y = training_windows([("a" * 100, "p"), ("b", "q")], ["p", "q"], window=64)
    assert (x < 256).sum() == 101 and list(y) == [0, 0, 1]


def test_no_rows_and_no_labels(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert train(empty) is None and identify(empty, None).count() == 0
    assert identify(spark.createDataFrame([(1, "abc", None, None)], SCHEMA), None).first().lang_pred == UNKNOWN


def test_held_out_documents_of_the_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = query(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert len(got) > 200 and np.mean([r.lang == r.lang_pred for r in got]) > 0.98


def test_scores_equal_a_loop_over_positions():
    """Every window on its own, every step of both networks by plain formulas."""
    model = ByteTagger(["a", "b", "none"], hidden=4, seed=3)
    sig = lambda v: 1 / (1 + np.exp(-v))

    def run(net, codes):
        h, out = np.zeros(net.h), []
        for c in codes:
            e, g = net.table[c], h @ net.u
            z, r = sig(g[: net.h] + e[: net.h]), sig(g[net.h :] + e[net.h : 2 * net.h])
            h = h + z * (np.tanh((r * h) @ net.uc + e[2 * net.h :]) - h)
            out.append(h)
        return out

    for text in ("ab é", "x" * 130, "kalo mi " * 9):
        raw = np.frombuffer(text.encode(), np.uint8)
        total = np.zeros(3)
        for k in range(0, len(raw), WINDOW):
            codes = [*raw[k : k + WINDOW].tolist()] + [256] * max(0, k + WINDOW - len(raw))
            fore, back = run(model.fore, codes), run(model.back, codes[::-1])[::-1]
            for f, b, c in zip(fore, back, codes):
                if c < 256:
                    p = np.exp(np.concatenate([f, b]) @ model.w + model.b)
                    total += p / p.sum()
        assert np.allclose(model.score(raw, np.array([0, len(raw)]))[0], total / len(raw), atol=1e-4)
