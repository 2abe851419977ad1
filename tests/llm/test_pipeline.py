"""The stages on planted cases, one after the other, and each one's own decisions."""

import random

import pytest

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra int"


def planted(sf_rows):
    rnd = random.Random(4)
    noise = lambda n: " ".join(f"word{rnd.randrange(10**5)}" for _ in range(n))
    passage, item = noise(70), noise(30)
    near = noise(200).split()
    rows = [(1, noise(60)), (2, noise(40) + " " + passage), (3, passage + " " + noise(40)), (4, " ".join(near)), (5, " ".join([*near[:100], "edit", *near[101:]])), (6, noise(80)), (7, rows_text := noise(90)), (8, rows_text), (9, "123 456 !!"), (10, None), (11, noise(20) + " " + item), (12, "")]
    return [(d, t, "en", "s", len(t or ""), 0) for d, t in rows], passage, item


def test_stages(spark, tmp_path):
    rows, passage, item = planted(20)
    sf = str(tmp_path)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs, seen = spark.createDataFrame(rows, SCHEMA), []
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, sf)
        docs.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        seen.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
        if name != "packing":
            assert docs.columns == cp.COLUMNS
        if name == "repeated_passages":
            texts = {r.doc_id: r.text for r in docs.collect()}
            assert passage in texts[2] and passage not in texts[3]
            assert texts[6] == rows[5][1]
    assert seen[0] == [1, 2, 3, 4, 5, 6, 7, 8, 11]
    assert seen[1] == [1, 2, 3, 4, 6, 7, 11]
    assert seen[2] == seen[1]
    assert seen[3] == [1, 2, 3, 4, 6, 7]
    assert seen[4] == seen[3]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, lang, None, len(t or ""), 0) for d, t, lang in rows], SCHEMA).repartition(3)


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


@pytest.mark.parametrize("few", [250_000, 0])
def test_near_duplicates_of_null_and_repeated_ids(spark, monkeypatch, few):
    """Different texts of one id are judged apart, and none is lost; with decisions broadcast and by a shuffle."""
    monkeypatch.setattr(cp, "BROADCAST_ROWS", few)
    rnd = random.Random(7)
    noise = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    a, b, c = noise(60), noise(60), noise(40)
    near = " ".join([*a.split()[:-1], "edit"])
    rows = [(1, a), (1, b), (2, c), (1, a), (3, near), (None, a), (None, a), (4, ""), (4, ""), (5, None), (6, b), (7, c.upper()), (2, "own " + noise(20))]
    got = pairs(cp.drop_near_duplicates(spark, frame(spark, [(*r, "en") for r in rows]), ""))
    assert got == sorted([(1, a), (1, b), (2, c), (None, a), (None, a), (4, ""), (4, ""), (5, None), rows[-1]], key=str)


def test_decontamination_of_null_and_repeated_ids(spark, tmp_path):
    rnd = random.Random(8)
    item, clean = (" ".join(f"w{rnd.randrange(10**6)}" for _ in range(30)) for _ in range(2))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, item), (1, clean), (None, item), (None, clean), (2, f"{clean} {item}"), (2, f"{clean} {item}"), (3, None), (4, "")]
    got = pairs(cp.drop_contaminated(spark, frame(spark, [(*r, "en") for r in rows]), str(tmp_path)))
    assert got == sorted([(1, clean), (None, clean), (3, None), (4, "")], key=str)


def test_languages_reject_noise_and_keep_short_documents(spark):
    """Planted junk goes (strings of hexadecimal digits aren't judged), planted short documents stay; rows without ids, languages or sources are judged by their texts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").where("text IS NOT NULL").collect()
    rnd = random.Random(3)
    junk = [" ".join("".join(rnd.choices(kind, k=rnd.randint(2, 12))) for _ in range(rnd.randint(6, 80))) for kind in ("abcdefghijklmnopqrstuvwxyz", "!#$%&()*+a", "бвгджзклмнпрст", "qxzjkvw") for _ in range(8)]
    short = sorted({" ".join(t.split()[:n]) for n, (_, t, lang) in zip([3, 4, 6] * 20, docs) if t.strip() and "#" not in t[:60] and "%" not in t[:60]})
    rows = [tuple(r) for r in docs] + [(10**6 + k, t, None) for k, t in enumerate(junk)] + [(None, t, None) for t in short]
    got = cp.keep_known_languages(spark, frame(spark, rows), "").collect()
    kept = [r.doc_id for r in got]
    assert sum(d is not None and d >= 10**6 for d in kept) <= 0.1 * len(junk)
    assert sum(d is None for d in kept) >= 0.95 * len(short)
    assert sum(d is not None and d < 10**6 for d in kept) >= 0.99 * len(docs)


def test_no_documents(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert cp.run(spark, sf).count() == 0


def test_stages_are_named_in_order():
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_duplicates", "repeated_passages", "decontamination", "packing"]
