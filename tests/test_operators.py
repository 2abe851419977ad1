"""Operators on small hand-made frames."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from extentlake.functions import columns as C
from extentlake.operators import checks, mutations, namespace, placement, recovery, rollup, wal, xor
from extentlake.plans import catalog, catalog_more  # noqa: F401
from extentlake.streaming import state


def test_xor_pads_to_the_longest_and_is_its_own_inverse():
    a, b = b"abc", b"abcd"
    assert xor.xor_bytes([a, b]) == b"\0\0\0d"
    parts = [random.Random(k).randbytes(k * 3) for k in range(1, 6)]
    parity = xor.xor_bytes(parts)
    for k, p in enumerate(parts):
        assert xor.xor_bytes([parity, *parts[:k], *parts[k + 1 :]])[: len(p)] == p


def test_xor_of_blobs_in_arrow(spark):
    df = spark.createDataFrame([(1, b"abc"), (1, b"abcd"), (2, b"x")], "pg long, content binary")
    assert {(r.pg, bytes(r.parity)) for r in xor.xor_blobs(df).collect()} == {(1, b"\0\0\0d"), (2, b"x")}


@pytest.mark.parametrize(
    ("states", "bad"),
    [
        (["prepared", "data-written", "parity-written", "metadata-written", "committed"], None),
        (["prepared", "aborted"], None),
        (["prepared", "committed"], ("prepared", "committed")),
        (["prepared", "data-written", "replay-required", "committed"], None),
        (["prepared", "data-written", "parity-written", "aborted"], ("parity-written", "aborted")),
    ],
)
def test_transitions(spark, states, bad):
    j = spark.createDataFrame([(1, k, s, False) for k, s in enumerate(states)], "tx long, seq long, state string, repair boolean")
    got = [(r.from_state, r.to_state) for r in wal.illegal_transitions(j).collect()]
    assert got == ([bad] if bad else [])


def test_repair_transactions_may_skip_parity(spark):
    j = spark.createDataFrame([(1, k, s, True) for k, s in enumerate(["prepared", "data-written", "committed"])], "tx long, seq long, state string, repair boolean")
    assert wal.illegal_transitions(j).count() == 0
    assert wal.replay_summary(j).count() == 0


def test_recovery_uses_the_last_record_before_replay_was_asked_for(spark):
    j = spark.createDataFrame([(1, 1, "prepared", False), (1, 2, "replay-required", False), (2, 1, "replay-required", False)], "tx long, seq long, state string, repair boolean")
    got = {r.tx: (r.effective_state, r.action) for r in wal.recovery_plan(j).collect()}
    assert got[1] == ("prepared", "abort")
    assert got[2][1] == "unsupported"


def test_greedy_placement_prefers_new_disks_then_load_then_room():
    disks = [(1, 0, 100), (2, 0, 200), (3, 5, 900)]
    assert placement.place_greedily(disks, [(1, 1, 10), (2, 1, 10), (3, 1, 10), (4, 1, 10)]) == [(1, 2), (2, 1), (3, 3), (4, 2)]
    with pytest.raises(ValueError):
        placement.place_greedily([(1, 0, 5)], [(1, 1, 10)])


def test_greedy_placement_sees_every_disk(spark):
    """More than 4096 eligible disks, whose free bytes grow with the id; and fewer disks than a file has extents."""
    rnd, extents = random.Random(3), []
    for file in range(6):
        extents += [(file, file * 1000 + n, file * 1000 + n // 3, rnd.randrange(1, 50)) for n in range(rnd.randrange(1, 18))]
    x = spark.createDataFrame(extents, "file_id long, extent_no long, pg long, length long")
    for count in (8000, 4):
        every = [(d, "parity" if d % 10 == 0 else "data", "failed" if d % 11 == 0 else "Online", (1000 + d // 2) * (d % 5)) for d in range(1, count + 1)]
        ready = [(d, 0, free) for d, role, health, free in every if role == "data" and health == "Online" and free > 0]
        want = [placed for file in range(6) for placed in placement.place_greedily(ready, [e[1:] for e in extents if e[0] == file])]
        d = spark.createDataFrame(every, "disk_id long, role string, health string, free long").repartition(3)
        assert sorted((r.extent_no, r.disk_id) for r in placement.greedy_placement(x, d).collect()) == sorted(want)


def test_relocation_goes_to_the_least_loaded_disk_with_room(spark):
    """Uneven loads, a disk without room, one with room for short extents only, and an extent that fits nowhere."""
    rnd = random.Random(5)
    disks = [(1, "data", "online", 90), (2, "data", "online", 0), (3, "data", "online", 30), (4, "data", "online", 90), (5, "data", "online", 900), (6, "data", "failed", 900), (7, "parity", "online", 900)]
    held = {1: 20, 3: 2, 4: 9, 5: 60}
    owners = [d for d, n in held.items() for _ in range(n)]
    rnd.shuffle(owners)
    extents = [(n, d, 100 if n == 40 else rnd.randrange(1, 60)) for n, d in enumerate(owners)]
    extents[40] = (40, 5, 100)
    load, want = {d: sum(e[1] == d for e in extents) for d in (1, 2, 3, 4)}, {}
    free = {d: f for d, _, _, f in disks}
    for n, d, length in extents:
        if d == 5:
            fits = [c for c in load if free[c] >= length]
            want[n] = min(fits, key=lambda c: (load[c], -free[c], c)) if fits else None
            if fits:
                load[want[n]] += 1
    x = spark.createDataFrame(extents, "extent_no long, data_disk long, length long").repartition(3)
    got = {r.extent_no: r.new_disk for r in placement.relocate(x, spark.createDataFrame(disks, "disk_id long, role string, health string, free long"), 5).collect()}
    assert got == want and {1, 3, 4, None} == set(got.values())


def test_strict_mode_sees_two_lost_data_disks(spark):
    x = spark.createDataFrame([(1, 7, 1, 10, False), (2, 7, 2, 10, False), (3, 7, 3, 10, True)], "extent_no long, pg long, data_disk long, length long, present boolean")
    g = spark.createDataFrame([(7, 9, True)], "pg long, parity_disk long, present boolean")
    assert recovery.multi_disk(x, g).first().possible
    assert not recovery.multi_disk(x, g, strict=True).first().possible


def test_health_has_hysteresis_and_failing_stays():
    def run(*failed):
        s = ("ok", 0)
        for f in failed:
            s = state.health_step(*s, f)
        return s

    assert run(True, False) == ("ok", 0)
    assert run(True, True, False) == ("suspect", 1)
    assert run(True, True, True, False, False) == ("failing", 3)


def test_breaker_opens_and_recovers():
    s = ("closed", 0, 0)
    for at in (1, 2, 3):
        *s, through = state.breaker_step(*s, at, True)
    assert s[0] == "open"
    *s, through = state.breaker_step(*s, 10, False)
    assert not through
    *s, through = state.breaker_step(*s, 100, False)
    assert through and s[0] == "closed" and s[1] == 0


def test_fold_equals_python_for_every_key(spark):
    rnd = random.Random(3)
    rows = [(d, k, k, rnd.random() < 0.5) for d in range(20) for k in range(30)]
    rnd.shuffle(rows)
    got = {r.disk: (r.final_state, r.failures) for r in state.final_health(spark.createDataFrame(rows, "disk long, ts long, event_id long, failed boolean")).collect()}
    for d in range(20):
        s = ("ok", 0)
        for r in sorted(r for r in rows if r[0] == d):
            s = state.health_step(*s, r[3])
        assert got[d] == s


def test_streaming_health_equals_the_batch_fold(spark, tmp_path):
    rows = [(d, k, (d * k) % 3 == 1) for d in range(5) for k in range(6)]
    src = spark.createDataFrame(rows, "disk long, seq long, failed boolean")
    src.where("seq < 3").write.parquet(f"{tmp_path}/in/a")
    src.where("seq >= 3").write.parquet(f"{tmp_path}/in/b")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    checks_ = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 100).parquet(f"{tmp_path}/in/*")
    q = state.stream_health(checks_).writeStream.outputMode("update").format("memory").queryName("health").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None
    got = {r.disk: (r.status, r.failures) for r in spark.table("health").collect()}
    for d in range(5):
        s = ("ok", 0)
        for r in sorted(r for r in rows if r[0] == d):
            s = state.health_step(*s, r[2])
        assert got[d] == s


def test_clean_catalog_has_no_violations(spark):
    x = spark.createDataFrame([(1, 1, 1, 1, 10, "c", "blake3"), (2, 1, 2, 1, 10, "", "")], "extent_no long, file_id long, data_disk long, pg long, length long, checksum string, checksum_alg string")
    files, disks = spark.range(1, 2).toDF("file_id"), spark.range(1, 3).toDF("disk_id")
    for df in (checks.checksum_algorithm(x), checks.positive_length(x), checks.dangling_files(x, files), checks.dangling_disks(x, disks), checks.duplicate_extents(x), checks.aliased_members(x), checks.group_references(x, x.select("pg").distinct(), x.select("pg", "extent_no"))):
        assert df.count() == 0


def test_listing_keeps_the_first_kind_of_a_name(spark):
    f = spark.createDataFrame([(1, "/a/x"), (2, "/a/x/y"), (3, "/a/d/e"), (4, "/b")], "file_id long, path string")
    assert {(r.name, r.is_dir) for r in namespace.listing(f, "/a").collect()} == {("x", False), ("d", True)}
    assert {r.name for r in namespace.listing(f, "").collect()} == {"a", "b"}
    assert namespace.lookup(f, "/a").first().kind == "directory"
    assert namespace.lookup(f, "/b").first().kind == "file"
    assert namespace.lookup(f, "/c").count() == 0


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "k long, v string")
    once = mutations.upsert(old, new, "k").drop("source")
    twice = mutations.upsert(once, new, "k").drop("source")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a"), (2, "B"), (3, "c")]


def test_columns(spark):
    row = spark.range(1).select(
        C.numbered("pg", F.lit(1234567)).alias("long"), C.sanitized_disk(F.lit("dé/k")).alias("disk"), C.sanitized_disk(F.lit("")).alias("none"),
        C.bucket_index(F.lit(1000)).alias("bucket"), C.file_type(F.lit(0o120777)).alias("kind"), C.smart_attribute(F.lit('"id":5,"name":"a","value":7'), 5).alias("smart"),
    ).first()
    assert tuple(row) == ("pg-1234567", "d___k", "_", 1, "symlink", 7)


def test_scrub_history_keeps_the_newest_32_runs_of_a_pool(spark, tmp_path):
    rows = [(pool * 100 + n, pool, "P" if n % 3 == 0 else "F", datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n // 2)) for pool, runs in ((1, 40), (2, 32), (3, 5)) for n in range(runs)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    got = {(r.pool, r.k): (r.run_id, r.status) for r in catalog.QUERIES["agg28_scrub_history"](spark, str(tmp_path)).collect()}
    newest = {pool: sorted((r for r in rows if r[1] == pool), key=lambda r: (r[3], r[0]), reverse=True)[:32] for pool in (1, 2, 3)}
    assert got == {(pool, k): (r[0], "in_progress" if r[2] == "P" else "completed") for pool, runs in newest.items() for k, r in enumerate(runs, 1)}


def test_affected_ids_of_every_file(spark, tmp_path):
    lines = [(file, n, 1, 1, float(n), 1.0, 0.0, 0.0, "N", "O", datetime.datetime(2024, 1, 1)) for file in range(1, 26) for n in range(1, file % 4 + 2)]
    kinds = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    spark.createDataFrame(lines, kinds).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.file_id: r.ids for r in catalog.QUERIES["fil14_affected_ids"](spark, str(tmp_path)).collect()}
    assert got == {file: ",".join(str(file * 1000 + n) for n in range(1, file % 4 + 2)) for file in range(1, 26)}


def test_admission_counts_every_open_transaction(spark, tmp_path):
    spark.createDataFrame([(tx, "O" if tx < 4 else "F") for tx in range(1, 8)], "o_orderkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(11,), (12,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    assert [tuple(r) for r in catalog.QUERIES["wal10_admission"](spark, str(tmp_path)).collect()] == [("refuse", 3)]


def test_blake3_paths_of_the_whole_table(spark):
    """The vectorised digests against the plain ones."""
    from extentlake.functions.blake3 import _node, ROOT
    from extentlake.plans import catalog, catalog_files  # noqa: F401

    rows = catalog.QUERIES["fn15_extent_path_blake3"](spark, "/root/testdata/sf0.001").collect()
    digest = {f: b"".join(w.to_bytes(4, "little") for w in _node(f.encode(), 0, ROOT)).hex() for f in {r.file for r in rows}}
    assert len(rows) > 5000 and all(r.path == f"data/{digest[r.file][:2]}/{digest[r.file][2:4]}/extent-{r.extent_no:06d}.bin" for r in rows)


def test_greedy_placement_of_the_whole_table(spark):
    """Every file on its own, all disks looked at for every extent."""
    from extentlake.plans import catalog
    from extentlake.plans.workload import Pool

    p = Pool(spark, "/root/testdata/sf0.001")
    disks = [(r.disk_id, r.free) for r in p.disks().collect() if r.role == "data" and r.health == "online" and r.free > 0]
    files = {}
    for r in p.extents().collect():
        files.setdefault(r.file_id, []).append((r.extent_no, r.pg, r.length))
    want = []
    for rows in files.values():
        count, free, used = dict.fromkeys((d for d, _ in disks), 0), dict(disks), {}
        for extent, pg, length in sorted(rows):
            open_ = [d for d in free if free[d] > 0]
            fresh = [d for d in open_ if d not in used.get(pg, ())] or open_
            d = sorted(fresh, key=lambda d: (count[d], -free[d], d))[0]
            count[d] += 1
            free[d] -= length
            used.setdefault(pg, set()).add(d)
            want.append((extent, d))
    got = catalog.QUERIES["plc01_greedy_placement"](spark, "/root/testdata/sf0.001")
    assert sorted(tuple(r) for r in got.select("extent_no", "disk_id").collect()) == sorted(want)


def test_groups_stay_whole_behind_a_join(spark):
    """Adaptive execution may replace a join's exchange; a group's sum must not be split by that."""
    from extentlake.operators.xor import xor_blobs

    a = spark.range(3000).selectExpr("id % 700 AS pg", "cast(cast(id AS string) AS binary) AS content")
    some = spark.range(700).where("id % 3 = 0").select((F.col("id")).alias("pg")).groupBy("pg").count().select("pg")
    got = xor_blobs(a.join(some, "pg", "left_semi")).collect()
    assert len(got) == len({r.pg for r in got}) == 234


def test_used_share_of_a_pool_of_two_exabytes(spark):
    disks = spark.createDataFrame([("data", 1 << 60, 1 << 58), ("parity", 1 << 60, 0)], "role string, capacity long, free long")
    got = rollup.pool_stats(disks, spark.createDataFrame([(5,)], "length long"), spark.range(2)).first()
    assert (got.total_bytes, got.used_bytes, got.used_bp) == (1 << 61, (1 << 61) - (1 << 58), 8750)
    assert rollup.pool_stats(disks.where("false"), spark.createDataFrame([(5,)], "length long"), spark.range(2)).first().used_bp is None


def test_xor_sums_of_unequal_runs_and_matrices(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rnd = random.Random(7)
    keys = np.array(sorted(rnd.randrange(40) for _ in range(300)))
    parts = [rnd.randbytes(rnd.choice((0, 1, 7, 300))) for _ in keys]
    want = [(k, xor.xor_bytes([p for j, p in zip(keys, parts) if j == k])) for k in sorted(set(keys.tolist()))]
    assert xor.xor_runs(keys, pa.array(parts, pa.binary())) == want
    assert xor.xor_runs(np.array([1, 1]), pa.array([b"", b""], pa.binary())) == [(1, b"")]


def test_xor_moves_no_contents(spark):
    """Contents that are an expression are made behind the shuffle, with the same sums, also over many batches and matrices."""
    x = spark.range(3000).selectExpr("id % 700 AS pg", "id", "id % 50 AS k")
    content = F.repeat(F.sha2(F.col("id").cast("string"), 256), F.col("k").cast("int")).cast("binary")
    late = xor.xor_blobs(x, content=content)
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert plan.index("sha2") < plan.index("Exchange")
    want = sorted(map(tuple, xor.xor_blobs(x.select("pg", content.alias("content"))).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        assert sorted(map(tuple, late.collect())) == want and len(want) == 700
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_reads_of_files_from_a_table_and_from_a_function(spark):
    """Files over several batches: whole, healed, lost, of another size, without extents, unknown."""
    from extentlake.functions.blake3 import blake3
    from extentlake.operators import blobs_io

    x, parts = [], {}
    for file in range(40):
        for n in range(1, file % 5 + 1):
            number = file * 10 + n
            parts[number] = bytes([n]) * (number % 9)
            x.append((number, file, file, n * 100, number % 9, blake3(parts[number]).hex()))
    bad = {n for n in parts if n % 11 == 0}
    back = {n for n in bad if n % 2 == 0}
    catalog = spark.createDataFrame(x, "extent_no long, pg long, file_id long, logical_offset long, length long, checksum string")
    blobs = spark.createDataFrame([(n, b"?" if n in bad else c) for n, c in parts.items() if n % 33], "extent_no long, content binary")
    on_disk = F.create_map(*[c for n, b in blobs.collect() for c in (F.lit(n).cast("long"), F.lit(bytes(b)))])
    judged = blobs_io.verdicts(catalog, blobs).cache()
    unsound = {r.extent_no for r in judged.where("NOT sound").collect()}
    assert unsound == {n for n in bad if parts[n] != b"?" * (n % 9 > 0) + b"\0" * (n % 9 - 1)} | {n for n in bad if n % 33 == 0}
    healed = spark.createDataFrame([(n, parts[n]) for n in back & unsound], "extent_no long, content binary")
    size = {f: sum(len(c) for n, c in parts.items() if n // 10 == f) + (f % 7 == 0) for f in range(40) if f != 9}
    files = spark.createDataFrame([*size.items(), (99, 5)], "file_id long, size_bytes long")
    want = {}
    for f in size:
        own = sorted(n for n in parts if n // 10 == f)
        if own and (set(own) & unsound) - back:
            want[f] = (None, None, "lost extent", None)
        elif own and f % 7 == 0:
            want[f] = (None, None, "I13", None)
        elif own:
            content = b"".join(parts[n] for n in own)
            want[f] = (len(content), ",".join(str(n) for n in own if n in unsound), None, content)
    assert {v[2] for v in want.values()} == {"lost extent", "I13", None} and any(v[1] for v in want.values())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        for source in (blobs, lambda rows: rows.withColumn("content", F.try_element_at(on_disk, "extent_no"))):
            got = blobs_io.read_files(files, judged, source, healed).collect()
            assert {r.file_id: (r.bytes_read, r.healed_extents, r.error, r.content if r.content is None else bytes(r.content)) for r in got} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_greedy_placement_streams_files_over_batches(spark):
    """Files of up to 17 extents in batches of 5 rows, without a call for each file."""
    rnd = random.Random(11)
    extents = [(file, file * 1000 + n, file * 1000 + n // 3, rnd.randrange(1, 50)) for file in range(30) for n in range(rnd.randrange(1, 18))]
    x = spark.createDataFrame(rnd.sample(extents, len(extents)), "file_id long, extent_no long, pg long, length long").repartition(3)
    ready = [(d, 0, 1000 + d % 3) for d in range(9)]
    d = spark.createDataFrame([(k, "data", "online", free) for k, _, free in ready], "disk_id long, role string, health string, free long")
    want = [placed for file in range(30) for placed in placement.place_greedily(ready, [e[1:] for e in extents if e[0] == file])]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        df = placement.greedy_placement(x, d)
        assert sorted((r.extent_no, r.disk_id) for r in df.collect()) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroups" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(params=["java", "python"])
def rows_in(request, spark, monkeypatch):
    """Both paths of functions on rows: Java, and Python where Java can't be compiled."""
    from extentlake.functions import jvm

    if request.param == "python":
        monkeypatch.setattr(jvm, "_loaded", (spark.sparkContext.applicationId, None))
    return request.param


def test_digests_of_rows(spark, rows_in):
    """Blobs around the ends of blocks, chunks and levels of the tree, many to a batch and longer than one; null of null."""
    from extentlake.functions.blake3 import _node, ROOT, with_digest

    rnd = random.Random(5)
    sizes = [0, 1, 63, 64, 65, 1023, 1024, 1025, 2047, 2048, 2049, 3072, 3073, 4097, 7168, 300_001, *[rnd.randrange(0, 6000) for _ in range(400)]]
    blobs = [(k, None if k % 37 == 36 else rnd.randbytes(n), datetime.date(2020, 1, 1)) for k, n in enumerate(sizes)]
    df = spark.createDataFrame(blobs, "id int, content binary, day date").coalesce(1)
    out = with_digest(df, "digest", F.col("content"))
    got = out.collect()
    assert out.columns == ["id", "content", "day", "digest"] and [r.id for r in got] == list(range(len(sizes)))
    for (_, blob, day), r in zip(blobs, got):
        assert r.day == day and (r.content is None if blob is None else bytes(r.content) == blob)
        want = None if blob is None else b"".join(w.to_bytes(4, "little") for w in _node(blob, 0, ROOT)).hex()
        assert r.digest == want
    assert [r.content for r in with_digest(df, "content", F.col("content")).collect()] == [r.digest for r in got]


def test_reads_of_files_stay_in_the_jvm(spark):
    """No content of a file or a blob passes through Python, which takes most of the time of large reads."""
    from extentlake.operators import blobs_io

    rows = [(10 + n, 1, 1, 4 * n, 4, "") for n in range(3)]
    catalog = spark.createDataFrame(rows, "extent_no long, pg long, file_id long, logical_offset long, length long, checksum string")
    judged = blobs_io.verdicts(catalog, lambda rows: rows.withColumn("content", F.lit(b"abcd")))
    files, none = spark.createDataFrame([(1, 12)], "file_id long, size_bytes long"), spark.createDataFrame([], "extent_no long, content binary")
    read = blobs_io.read_files(files, judged, lambda rows: rows.withColumn("content", F.lit(b"abcd")), none)
    assert [(r.bytes_read, r.healed_extents, r.error, bytes(r.content)) for r in read.collect()] == [(12, "", None, b"abcd" * 3)]
    for df in (judged, read):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan and "ArrowEvalPython" not in plan


def test_files_are_assembled_alike_in_java_and_python(spark, rows_in):
    """Two rows of one file, an extent that is lost, one that is mended, another size, no extents, no file; empty blobs."""
    from extentlake.operators import blobs_io

    x = [(1, 0, 5, b"ab", True), (1, 2, 6, b"", True), (1, 2, 7, b"c", True), (2, 0, 8, None, True), (2, 9, 9, b"x", True), (3, 0, 20, None, False), (3, 1, 21, b"zz", True), (4, 0, 30, b"q", True), (6, 0, 40, b"r", True), (7, 0, 50, b"", True)]
    content = F.create_map(*[c for _, _, n, b, _ in x if b is not None for c in (F.lit(n).cast("long"), F.lit(b))])
    judged = spark.createDataFrame([(f, o, n, 1, 1 if b is None else len(b), s) for f, o, n, b, s in x], "file_id long, logical_offset long, extent_no long, pg long, length long, sound boolean")
    healed = spark.createDataFrame([(20, b"y")], "extent_no long, content binary")
    files = spark.createDataFrame([(1, 3), (1, 3), (1, 4), (2, 2), (3, 3), (4, 2), (5, 0), (7, 0)], "file_id long, size_bytes long")
    got = blobs_io.read_files(files, judged, lambda rows: rows.withColumn("content", F.try_element_at(content, "extent_no")), healed)
    got = sorted((r.file_id, r.error or "", r.bytes_read, r.healed_extents, None if r.content is None else bytes(r.content)) for r in got.collect())
    whole = (1, "", 3, "", b"abc")
    assert got == [whole, whole, (1, "I13", None, None, None), (2, "lost extent", None, None, None), (3, "", 3, "20", b"yzz"), (4, "I13", None, None, None), (7, "", 0, "", b"")]


def test_sums_of_blobs_in_java_and_python(spark, rows_in):
    """Unequal lengths, empty and null blobs; a group of nothing but nulls has no sum. Runs go on over batches."""
    rnd = random.Random(11)
    rows = [(k, None if rnd.random() < 0.1 else rnd.randbytes(rnd.choice((0, 1, 7, 8, 9, 300)))) for k in range(90) for _ in range(rnd.randrange(1, 6))]
    rows += [(100, None), (100, None), (101, b""), (102, None), (102, b"x")]
    parts = {k: [c for j, c in rows if j == k and c is not None] for k, _ in rows}
    want = {k: xor.xor_bytes(p) for k, p in parts.items() if p}
    assert 100 not in want and want[101] == b""
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "pg long, content binary")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for arrow in (False, True):
            got = xor.xor_blobs(df, arrow=arrow).collect()
            assert len(got) == len(want) and {r.pg: bytes(r.parity) for r in got} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_only_peers_of_lost_extents_are_read_again(spark):
    """Spark must not ask for contents in front of the join that picks the groups."""
    from extentlake.operators import blobs_io

    judged = spark.range(900).selectExpr("id AS extent_no", "id div 3 AS pg", "64L AS length", "id % 90 <> 0 AS sound")
    some = judged.where("NOT sound").select("pg").distinct()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        peers = blobs_io.sound_blobs(judged.join(some, "pg", "left_semi"), lambda rows: rows.withColumn("content", F.sha2(F.col("extent_no").cast("string"), 256).cast("binary")))
        plan = xor.xor_blobs(peers)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("sha2") < plan.index("Join LeftSemi") and "sha2" not in plan[plan.index("Join LeftSemi") :]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_java_is_compiled_again_where_the_module_is_loaded_anew(spark):
    import importlib

    from extentlake.functions import blake3, jvm

    df = spark.createDataFrame([(b"abc",)], "content binary")
    for _ in range(2):
        assert blake3.with_digest(df, "d", F.col("content")).first().d == blake3.blake3(b"abc").hex()
        importlib.reload(jvm)
    plan = blake3.with_digest(df, "d", F.col("content"))._jdf.queryExecution().executedPlan().toString()
    assert "MapPartitions" in plan and "Python" not in plan


def test_partitions_of_contents_are_not_merged_by_the_bytes_of_keys(spark):
    """Contents are made behind the shuffle; adaptive execution sees a few bytes a row there and would leave one task."""
    from extentlake.operators import blobs_io

    x = spark.range(400).selectExpr("id AS pg", "id AS extent_no")
    judged = x.selectExpr("extent_no", "pg", "extent_no div 4 AS file_id", "extent_no AS logical_offset", "64L AS length", "true AS sound")
    files, none = judged.selectExpr("file_id", "256L AS size_bytes").distinct(), spark.createDataFrame([], "extent_no long, content binary")
    content = F.sha2(F.col("extent_no").cast("string"), 256).cast("binary")
    read = blobs_io.read_files(files, judged, lambda rows: rows.withColumn("content", content), none)
    for df in (xor.xor_blobs(x, content=content), read):
        assert df.select(F.spark_partition_id().alias("p")).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
