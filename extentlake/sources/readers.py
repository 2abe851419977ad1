"""DataFrames over the pool's files. Files are read through Spark (``binaryFile``), one row a file, and decoded in Arrow
batches on the executors; a snapshot or journal file is bounded by its format, so it fits into a task. Digests are computed for
many files at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import formats

#: Columns of the model that the binary formats don't hold; they are read as ''.
_UNSTORED = {"pool": ["protection_state"], "disks": ["mirror_of_disk"], "extents": ["protection_class", "mirror_disk_id", "mirror_checksum", "corruption_status"]}

_JOURNAL = (
    "seq bigint, tx_id string, state string, ts_ns bigint, pool_name string, logical_path string, old_generation bigint, new_generation bigint, affected_extent_ids array<string>, record_checksum string, "
    f"file struct<{formats.ddl(formats.FILE_SHORT).replace(' ', ':').replace(',:', ',')}>, extents array<struct<{formats.ddl(formats.EXTENT_SHORT).replace(' ', ':').replace(',:', ',')}>>"
)
_ISSUES = "path string, severity string, kind string, message string"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


#: Bytes of files, and rows of them, that are worked on at once.
BYTES, ROWS = 4 << 20, 20_000


def _portions(files: list[tuple[str, bytes]]) -> Iterator[list[tuple[str, bytes]]]:
    some, size = [], 0
    for f in files:
        some.append(f)
        size += len(f[1])
        if size >= BYTES:
            yield some
            some, size = [], 0
    if some:
        yield some


def _decoded(spark: SparkSession, path: str | DataFrame, schema: str, rows: Callable[[str, bytes, Callable], list[dict]]) -> DataFrame:
    """``path``: files, or a frame (path, content) of what they hold. ``rows``: of a file, with a function for its digests."""
    files = path.select("path", "content") if isinstance(path, DataFrame) else _files(spark, path)
    kind = spark.createDataFrame([], schema).schema
    arrow = to_arrow_schema(kind)

    def run(batches):
        for batch in batches:
            for some in _portions(list(zip(*(c.to_pylist() for c in batch.columns)))):
                digest = formats.digests_of([content for _, content in some])
                yield pa.RecordBatch.from_pylist([row for name, content in some for row in rows(name, content, digest)], schema=arrow)

    return files.mapInArrow(run, kind)


def snapshot(spark: SparkSession, path: str | DataFrame, table: str) -> DataFrame:
    """One table (pool, disks, files, extents, parity_groups, transactions, scrub_history) of the snapshots at ``path``."""
    fields = formats.POOL if table == "pool" else formats.TABLES[table]

    def rows(_, content, digest):
        got = formats.read_snapshot(content, digest)[table]
        return [got] if table == "pool" else got

    df = _decoded(spark, path, formats.ddl(fields), rows)
    return df.withColumns({c: F.lit("") for c in _UNSTORED.get(table, [])})


def journal(spark: SparkSession, path: str | DataFrame, mode: str = "DROP_TORN_TAIL") -> DataFrame:
    """Records with their place in the file; ``FAILFAST`` makes a torn tail an error."""
    drop = {"DROP_TORN_TAIL": True, "FAILFAST": False}[mode]
    return _decoded(spark, path, _JOURNAL, lambda _, content, digest: list(formats.read_journal(content, drop, digest)))


def rebuild_progress(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """extent_id of every extent that a rebuild has done."""
    return _decoded(spark, path, "extent_id string", lambda _, c, digest: [{"extent_id": i} for i in formats.read_rebuild_progress(c, digest)["completed_extents"]])


def scrub_progress(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """kind (extent or parity_group) and id of everything that a scrub has done."""

    def rows(_, content, digest):
        got = formats.read_scrub_progress(content, digest)
        return [{"kind": k, "id": i} for k in ("extent", "parity_group") for i in got[f"completed_{k}s"]]

    return _decoded(spark, path, "kind string, id string", rows)


def validate(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """path, severity, kind, message: what is wrong with the files at ``path``, told apart by their magic; a sound file has no row."""
    checks = {formats.SNAPSHOT_MAGIC: ("metadata", formats.read_snapshot), formats.REBUILD_MAGIC: ("rebuild", formats.read_rebuild_progress), formats.SCRUB_MAGIC: ("scrub", formats.read_scrub_progress)}

    def rows(name, content, digest):
        kind, read = checks.get(content[:4], ("journal", lambda data, digest: list(formats.read_journal(data, False, digest))))
        try:
            read(content, digest)
        except formats.FormatError as e:
            return [{"path": name, "severity": "warning" if "torn" in str(e) else "error", "kind": kind, "message": str(e)}]
        except (UnicodeDecodeError, IndexError) as e:
            return [{"path": name, "severity": "error", "kind": kind, "message": str(e)}]
        return []

    return _decoded(spark, path, _ISSUES, rows)


def catalog_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A catalog that was exported as JSON, with a fixed schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def _encoded(rows: DataFrame, key: str, encode: Callable[[list[list[dict]]], list[bytes]]) -> DataFrame:
    """path, content: one file for each key, made of its rows, of many keys at a time; a file is bounded by its format's 16-bit
    counts or by the journal of one pool."""

    def files(groups: list[list[dict]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([str(g[0][key]) for g in groups], pa.string()), pa.array(encode(groups), pa.binary())], ["path", "content"])

    def run(batches):
        groups, n = [], 0
        for batch in batches:
            for _, more in groupby(batch.to_pylist(), itemgetter(key)):
                more = list(more)
                if groups and groups[-1][0][key] == more[0][key]:
                    groups[-1] += more
                else:
                    # All groups but the last are whole.
                    if n >= ROWS:
                        yield files(groups)
                        groups, n = [], 0
                    groups.append(more)
                n += len(more)
        if groups:
            yield files(groups)

    # By a hash of the key, as in ``xor.xor_blobs``.
    return rows.repartition(F.xxhash64(key)).sortWithinPartitions(key).mapInArrow(run, "path string, content binary")


def snapshot_files(files: DataFrame, pool: str, saved_ns: int) -> DataFrame:
    """Snapshots of pools: ``files`` holds the column ``pool`` and those of the format's table of files."""

    def state(rows: list[dict]) -> dict:
        name = str(rows[0][pool])
        head = {"pool_id": name, "name": name, "version": "v1", "extent_size_bytes": 4096, "parity_mode": "single", "created_ns": saved_ns}
        return {"pool": head, "files": sorted(rows, key=lambda r: r["file_id"])}

    def encode(groups: list[list[dict]]) -> list[bytes]:
        return formats.write_snapshots([state(rows) for rows in groups], saved_ns)

    return _encoded(files, pool, encode)


def journal_files(records: DataFrame, pool: str) -> DataFrame:
    """Journals of pools from records (pool, seq, tx_id, state), in order of ``seq``."""

    def encode(groups: list[list[dict]]) -> list[bytes]:
        empty = {"ts_ns": 0, "old_generation": 0, "new_generation": 0, "logical_path": "", "affected_extent_ids": [], "file": None, "extents": []}
        rows = [empty | {"pool_name": str(r[pool]), "tx_id": r["tx_id"], "state": r["state"]} for g in groups for r in sorted(g, key=itemgetter("seq"))]
        written = iter(formats.write_records(rows))
        return [b"".join(islice(written, len(g))) for g in groups]

    return _encoded(records, pool, encode)


def progress_files(done: DataFrame, pool: str, updated_ns: int) -> DataFrame:
    """Checkpoints of rebuilds: the extents (pool, extent_id) that are done."""
    return _encoded(done, pool, lambda groups: [formats.write_rebuild_progress(sorted(r["extent_id"] for r in rows), updated_ns) for rows in groups])
