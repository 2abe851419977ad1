import gzip
import hashlib
import io

from extentlake.llm.warc import parse_records, read_archives, repeated_payloads, round_trip, write_archives

SCHEMA = "page_id long, url string, html string, digest string, n int"


def run(spark, pages):
    return sorted(map(tuple, round_trip(spark.createDataFrame([(*p, "clash", 1) for p in pages], SCHEMA)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact").collect()), key=str)


def test_largest_id_answers_and_small_payloads_are_whole(spark):
    big, crlf = "é\r\n\r\nWARC/1.1\r\n" * 100, "\r\n\r\n" * 500
    pages = [(1, "http://a/", big), (9, "http://b/\r\nX: y", big), (3, None, big), (4, "http://c", "s"), (5, "http://c", "s"), (6, "u", None), (7, "u", ""), (8, "u", crlf), (None, "u", big), (10, "u", "x" * 999), (11, "u", "x" * 999), (12, "v", "y" * 1000), (13, "v", "y" * 1000)]
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        top = max((j for j, _, g in pages if g == h and j is not None), default=None)
        revisit = len(raw) >= 1000 and i != top
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", top if revisit else None, None if revisit else True))
    assert run(spark, pages) == sorted(want, key=str)


def test_archives_are_whole_records(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a/", "x" * 2000, "", 0), (2, "http://b/", "x" * 2000, "", 0)], SCHEMA)
    write_archives(df, f"{tmp_path}/w")
    data = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "w").glob("*.gz")))
    assert data.count(b"WARC-Type: revisit") == 1 and data.count(b"x" * 2000) == 1
    assert {r[0] for r in parse_records(io.BytesIO(data))} == {1, 2}
    assert read_archives(spark, f"{tmp_path}/w").count() == 2


def test_headers_alone_are_shuffled(spark, tmp_path):
    """The plan that writes the archives has no exchange of payloads; beyond the size bound the join gives the same rows."""
    pages = [(k, "u", f"{k % 5}" * (900 + 40 * (k % 5)), "", 0) for k in range(60)]
    df = spark.createDataFrame(pages, SCHEMA)
    plan = repeated_payloads(df)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(digest" in plan
    got = []
    for limit in (10**7, -1):
        write_archives(df, f"{tmp_path}/w{limit}", broadcast_bytes=limit)
        got.append(sorted(map(tuple, read_archives(spark, f"{tmp_path}/w{limit}").collect()), key=str))
    assert got[0] == got[1] and len(got[0]) == 60
    assert sum(r[2] == "revisit" for r in got[0]) == 2 * 11


def test_record_ids_are_unique(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "x" * 2000, "", 0), (1, "u", "y", "", 0), (1, "v", "z" * 1500, "", 0), (2, "u", "x" * 2000, "", 0), (None, None, None, "", 0)], SCHEMA)
    write_archives(df, f"{tmp_path}/w")
    data = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "w").glob("*.gz")))
    ids = [x for x in data.split(b"\r\n") if x.startswith(b"WARC-Record-ID")]
    assert len(ids) == len(set(ids)) == 5 and sum(x == b"WARC-Refers-To: <urn:x-page:2>" for x in data.split(b"\r\n")) == 1


def test_repeated_rows_and_empty(spark):
    got = run(spark, [(1, "u", "z" * 1500), (1, "u", "z" * 1500), (0, "u", "z" * 1500)])
    assert [(g[0], g[3], g[4]) for g in got] == [(0, "revisit", 1), (1, "response", None), (1, "response", None)]
    assert run(spark, []) == []
