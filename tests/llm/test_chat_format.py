from extentlake.llm.chat_format import BLOCK, PART, format_chats

SCHEMA = "conv_id long, turn long, role string, text string, chat string"


def chats(spark, rows):
    out = {}
    for r in format_chats(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)).collect():
        out.setdefault(r.conv_id, []).append((r.part, r.n_turns, r.copies, r.chat))
    return {k: sorted(v) for k, v in out.items()}


def test_snapshots_and_copies_collapse(spark):
    a, b, c = ("user", "hi"), ("assistant", "hello"), ("user", "bye")
    rows = [(i, k, *t) for i, turns in {1: [a], 2: [a, b], 3: [a, b, c], 4: [a, b, c], 5: [a, c], 6: [b]}.items() for k, t in enumerate(turns)]
    got = chats(spark, rows)
    assert set(got) == {3, 5, 6}
    assert got[3] == [(0, 3, 2, "<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n<|user|>\nbye<|end|>\n")]


def test_nulls_ties_and_repeats(spark):
    rows = [(1, None, None, None), (1, 0, "user", ""), (2, None, "unknown", None), (2, 0, "user", ""), (None, 0, "user", "x"), (3, 0, "b", "x"), (3, 0, "a", "y"), (3, 0, "a", "y")]
    got = chats(spark, rows)
    assert set(got) == {1, 2, 3}  # a null role isn't the word unknown
    assert got[1][0][3] == "<|unknown|>\n<|end|>\n<|user|>\n<|end|>\n"
    assert got[3] == [(0, 3, 1, "<|a|>\ny<|end|>\n" * 2 + "<|b|>\nx<|end|>\n")]


def test_long_conversations_come_in_parts_and_keep_their_order(spark):
    n = BLOCK * 2 + 5
    rows = [(1, k, "u", str(k)) for k in range(n)] + [(2, k, "u", str(k)) for k in range(n - 1)]
    got = chats(spark, rows)
    assert set(got) == {1} and len(got[1]) == -(-n // PART)
    assert "".join(p[3] for p in got[1]) == "".join(f"<|u|>\n{k}<|end|>\n" for k in range(n))


def test_empty(spark):
    assert chats(spark, []) == {}
