"""Formats: round trips, damage, old versions; readers over files."""

import pytest

from extentlake.functions.blake3 import blake3
from extentlake.sources import formats, readers

POOL = {"pool_id": "p", "name": "pool é", "version": "1", "extent_size_bytes": 1 << 20, "parity_mode": "single", "created_ns": 5}
FILE = {"file_id": "f", "path": "/a", "size_bytes": 3, "mtime_ns": 1, "ctime_ns": -1, "policy": "", "state": "ok", "file_type": 2, "mode": 0o644, "link_target": "", "dev_major": 0, "dev_minor": 0}
EXTENT = {"extent_id": "extent-000001", "file_id": "f", "logical_offset": 0, "length": 3, "data_disk_id": "d", "relative_path": "data/x", "offset_bytes": 0, "length_bytes": 3, "checksum": "c", "checksum_alg": "blake3", "generation": 1, "parity_group_id": "pg-000001", "state": "allocated", "compression_alg": "", "compressed_size": 0}
STATE = {
    "pool": POOL,
    "disks": [{"disk_id": "d", "uuid": "u", "role": r, "filesystem_type": "x", "mountpoint": "/m", "capacity_bytes": 9, "free_bytes": 1, "health_status": "online", "generation": 0} for r in ("data", "parity", "metadata", "mirror")],
    "files": [FILE],
    "extents": [EXTENT],
    "parity_groups": [{"parity_group_id": "pg-000001", "parity_disk_id": "d", "member_extent_ids": ["extent-000001", ""], "parity_checksum": "", "generation": 7}],
    "transactions": [{"tx_id": "t", "state": "committed", "started_ns": 1, "committed_ns": c, "affected_extent_ids": [], "old_generation": 0, "new_generation": 1, "replay_required": False} for c in (None, 3)],
    "scrub_history": [{"run_id": "r", "started_ns": 1, "completed_ns": 2, "repair": True, "healthy": False, "files_checked": 5, "extents_checked": 10, "parity_groups_checked": 3, "healed_count": 2, "failed_count": 1, "issue_count": 3, "healed_extent_ids": ["e"], "healed_parity_group_ids": []}],
}
RECORDS = [
    {"tx_id": "t", "state": s, "ts_ns": k, "pool_name": "p", "logical_path": "/a", "old_generation": 0, "new_generation": 1, "affected_extent_ids": ["e"], "file": None if k else {n: FILE[n] for n, _ in formats.FILE_SHORT}, "extents": [{n: EXTENT[n] for n, _ in formats.EXTENT_SHORT}] * k}
    for k, s in enumerate(formats.STATE_CODES)
]


@pytest.mark.parametrize(("data", "digest"), [(b"", "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"), (b"abc", "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85")])
def test_blake3_vectors(data, digest):
    assert blake3(data).hex() == digest


def test_blake3_splits_trees_as_specified():
    seen = {blake3(bytes(i % 251 for i in range(n))) for n in (1, 64, 65, 1023, 1024, 1025, 2048, 2049, 3072, 3073, 8193)}
    assert len(seen) == 11


def test_snapshot_round_trip_and_lost_mirror_role():
    got = formats.read_snapshot(formats.write_snapshot(STATE, 42))
    assert got.pop("saved_ns") == 42
    assert [d["role"] for d in got["disks"]] == ["data", "parity", "metadata", "data"]
    want = STATE | {"pool": formats.POOL_DEFAULTS | POOL, "disks": got["disks"]}
    assert got == want


def test_version_one_gets_defaults():
    data = formats.write_snapshot(STATE, 1)
    new, old = formats.put_row(formats.POOL, formats.POOL_DEFAULTS | POOL), formats.put_row(formats.POOL_V1, POOL)
    payload = data[72:].replace(new, old, 1)
    head = bytearray(data[:40])
    head[5], head[24:28] = 1, len(payload).to_bytes(4, "big")
    assert formats.read_snapshot(bytes(head) + blake3(payload) + payload)["pool"] == formats.POOL_DEFAULTS | POOL


@pytest.mark.parametrize("at", [0, 5, 27, 45, 100])
def test_damaged_snapshots_are_refused(at):
    data = bytearray(formats.write_snapshot(STATE, 1))
    data[at] ^= 0xFF
    with pytest.raises(formats.FormatError):
        formats.read_snapshot(bytes(data))


def test_journal_round_trip_torn_tail_and_damage():
    data = b"".join(map(formats.write_record, RECORDS))
    got = list(formats.read_journal(data))
    assert [{k: v for k, v in r.items() if k not in ("seq", "record_checksum")} for r in got] == RECORDS
    for cut in (1, 3, 30, len(formats.write_record(RECORDS[-1])) - 1):
        assert len(list(formats.read_journal(data[: len(data) - cut]))) == len(RECORDS) - 1
        with pytest.raises(formats.FormatError):
            list(formats.read_journal(data[:-cut], drop_torn_tail=False))
    for at in (4, 80, 44):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(formats.FormatError):
            list(formats.read_journal(bytes(bad)))


def test_readers(spark, tmp_path):
    for name, data in {
        "snap.bin": formats.write_snapshot(STATE, 1), "journal.bin": b"".join(map(formats.write_record, RECORDS)) + b"\0\0",
        "r.progress": formats.write_rebuild_progress(["a", "b"], 7), "s.progress": formats.write_scrub_progress(True, ["a"], ["g"], 7),
    }.items():
        (tmp_path / name).write_bytes(data)
    assert [r.disk_id for r in readers.snapshot(spark, f"{tmp_path}/snap.bin", "disks").collect()] == ["d"] * 4
    e = readers.snapshot(spark, f"{tmp_path}/snap.bin", "extents").first()
    assert e.length == 3 and e.corruption_status == ""
    assert readers.snapshot(spark, f"{tmp_path}/snap.bin", "pool").first().sleep_timeout_sec == 300
    assert readers.snapshot(spark, f"{tmp_path}/snap.bin", "parity_groups").first().member_extent_ids == ["extent-000001", ""]
    j = readers.journal(spark, f"{tmp_path}/journal.bin").orderBy("seq").collect()
    assert [r.state for r in j] == list(formats.STATE_CODES) and j[0].file.path == "/a" and j[2].extents[1].checksum == "c"
    assert {r.extent_id for r in readers.rebuild_progress(spark, f"{tmp_path}/r.progress").collect()} == {"a", "b"}
    assert {(r.kind, r.id) for r in readers.scrub_progress(spark, f"{tmp_path}/s.progress").collect()} == {("extent", "a"), ("parity_group", "g")}
    (tmp_path / "bad.bin").write_bytes(formats.write_snapshot(STATE, 1)[:-1])
    issues = {(r.path.rsplit("/", 1)[1], r.severity, r.kind) for r in readers.validate(spark, str(tmp_path)).collect()}
    assert issues == {("bad.bin", "error", "metadata"), ("journal.bin", "warning", "journal")}


def test_many_digests_at_once_are_those_of_single_files(monkeypatch):
    """Snapshots, journals and progress files, sound, torn and damaged: their readers ask for digests that are known."""
    states = [STATE | {"files": [FILE | {"path": "/" + "x" * k}] * k} for k in range(5)]
    assert formats.write_snapshots(states, 7) == [formats.write_snapshot(s, 7) for s in states]
    assert formats.write_records(RECORDS) == [formats.write_record(r) for r in RECORDS]
    journal = b"".join(formats.write_records(RECORDS))
    torn, damaged = journal[:-5], journal[:90] + b"?" + journal[91:]
    files = [*formats.write_snapshots(states, 7), journal, torn, damaged, b"", b"RT", formats.write_rebuild_progress(["a", "b"], 1), formats.write_scrub_progress(True, ["a"], ["g"], 1)]
    digest = formats.digests_of(files)
    monkeypatch.setattr(formats, "blake3", lambda part: pytest.fail("one digest alone"))
    assert [len(formats.read_snapshot(f, digest)["files"]) for f in files[:5]] == [0, 1, 2, 3, 4]
    assert len(list(formats.read_journal(journal, False, digest))) == len(RECORDS) == len(list(formats.read_journal(torn, True, digest))) + 1
    with pytest.raises(formats.FormatError):
        list(formats.read_journal(damaged, True, digest))
    assert formats.read_rebuild_progress(files[-2], digest)["completed_extents"] == ["a", "b"]
    assert formats.read_scrub_progress(files[-1], digest)["completed_parity_groups"] == ["g"]


def test_files_of_keys_that_span_batches(spark):
    rows = [(k % 7, k, str(k), "prepared") for k in range(200)] + [(None, 1, "n", "aborted")]
    records = spark.createDataFrame(rows, "pool long, seq long, tx_id string, state string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 9)
    try:
        made = readers.journal_files(records, "pool").collect()
        got = readers.journal(spark, readers.journal_files(records, "pool")).select("pool_name", "seq", "tx_id").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r.path for r in made) == [*"0123456", "None"]
    want = [(str(p), (k - p) // 7, str(k)) for p in range(7) for k in range(200) if k % 7 == p] + [("None", 0, "n")]
    assert sorted(map(tuple, got)) == sorted(want)
