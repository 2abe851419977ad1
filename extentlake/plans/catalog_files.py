"""The rest of the catalogue: files in the pool's formats, identities and configuration, orders, names, sinks. Importing it adds to
``catalog``."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import blobs_io, changes, checks, faults, mutations, namespace, recovery, requests, rollup, wal
from ..sources import config, readers, tables
from ..streaming import state
from .catalog import _REASON, query
from .catalog_state import _blobs, _catalog, _files

_SAVED_NS = 1_700_000_000_000_000_000

# Formats. Every customer is a pool with its orders as files; a pool's file is damaged where its number is a multiple of 7 or 11.


def _snapshots(p):
    o = p.table("orders").select(F.col("o_custkey").alias("pool"), F.col("o_orderkey").alias("k"))
    zero, text = F.lit(0).cast("long"), lambda v: F.lit(v)
    f = o.select(
        "pool", F.col("k").cast("string").alias("file_id"), F.concat(F.lit("/o"), F.col("k").cast("string")).alias("path"), (F.col("k") % 5000).alias("size_bytes"), zero.alias("mtime_ns"), zero.alias("ctime_ns"),
        text("default").alias("policy"), text("allocated").alias("state"), zero.alias("file_type"), (F.col("k") % 512).alias("mode"), text("").alias("link_target"), zero.alias("dev_major"), zero.alias("dev_minor"),
    )
    return readers.snapshot_files(f, "pool", _SAVED_NS)


def _journals(p):
    j = p.journal().join(p.table("orders").select(F.col("o_orderkey").alias("tx"), F.col("o_custkey").alias("pool")), "tx")
    return readers.journal_files(j.select("pool", "seq", F.col("tx").cast("string").alias("tx_id"), "state"), "pool")


@query("src02_snapshot", "", "SELECT CAST(o_orderkey AS VARCHAR) AS file_id, '/o' || o_orderkey AS path, o_orderkey % 5000 AS size_bytes, o_orderkey % 512 AS mode FROM orders")
def _(p):
    return readers.snapshot(p.spark, _snapshots(p), "files").select("file_id", "path", "size_bytes", "mode")


@query("src06_journal", "journal", """j AS (SELECT o_custkey AS pool, tx, seq, state FROM journal JOIN orders ON o_orderkey = tx), n AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY pool) AS c FROM j)
--
SELECT CAST(tx AS VARCHAR) AS tx_id, state, i AS seq FROM n WHERE pool % 7 <> 0 OR i < c - 1""")
def _(p):
    torn = faults.damaged(_journals(p), F.col("path").cast("long") % 7 == 0, lambda c: faults.cut(c, 5))
    return readers.journal(p.spark, torn).select("tx_id", "state", "seq")


@query("src10_rebuild_progress", "ext", "SELECT CAST(extent_no AS VARCHAR) AS extent_id FROM ext WHERE extent_no % 9 = 0")
def _(p):
    done = p.extents().where("extent_no % 9 = 0").select((F.col("file_id") % 200).alias("pool"), F.col("extent_no").cast("string").alias("extent_id"))
    return readers.rebuild_progress(p.spark, readers.progress_files(done, "pool", _SAVED_NS))


@query("src21_format_sweep", "", """SELECT c AS path, 'error' AS severity, 'metadata' AS kind, CASE WHEN c % 7 = 0 THEN 'snapshot checksum' ELSE 'the payload is short' END AS message FROM (SELECT DISTINCT o_custkey AS c FROM orders) WHERE c % 7 = 0 OR c % 11 = 0
UNION ALL SELECT c, 'warning', 'journal', 'torn' FROM (SELECT DISTINCT o_custkey AS c FROM orders) WHERE c % 7 = 0""")
def _(p):
    k = F.col("path").cast("long")
    snapshots = faults.damaged(_snapshots(p), k % 7 == 0, lambda c: faults.flipped(c, 80))
    snapshots = faults.damaged(snapshots, (k % 11 == 0) & (k % 7 != 0), lambda c: faults.cut(c, 1))
    journals = faults.damaged(_journals(p), k % 7 == 0, lambda c: faults.cut(c, 5))
    out = readers.validate(p.spark, snapshots.unionByName(journals))
    message = F.when(F.col("message").contains("torn"), "torn").when(F.col("message").startswith("the payload has"), "the payload is short").otherwise(F.col("message"))
    return out.select(F.col("path").cast("long").alias("path"), "severity", "kind", message.alias("message"))


# Identities, pools, configuration, commands


def _identities(p):
    d = p.disks()
    return namespace.disk_identities(d.select((F.col("disk_id") % 10).alias("pool_id"), "disk_id", "role", F.when(F.col("disk_id") % 29 == 0, 99).otherwise(namespace.LAYOUT_VERSION).alias("layout_version")))


@query("src14_identities", "disks", "SELECT disk_id % 10 AS pool_id, disk_id, role, CASE WHEN disk_id % 29 = 0 THEN 'incompatible layout version' END AS error FROM disks")
def _(p):
    return namespace.read_identities(_identities(p))


@query("pool01_assembly", "disks", """SELECT pool_id, CASE WHEN found = 0 THEN 'failed' WHEN missing <> '' THEN 'degraded' ELSE 'online' END AS status, found, missing FROM (
  SELECT disk_id % 10 AS pool_id, count(*) FILTER (disk_id % 29 <> 0 AND disk_id % 23 <> 0 AND disk_id % 10 <> 4) AS found, coalesce(string_agg(CAST(disk_id AS VARCHAR), ',' ORDER BY disk_id) FILTER (NOT (disk_id % 29 <> 0 AND disk_id % 23 <> 0 AND disk_id % 10 <> 4)), '') AS missing FROM disks GROUP BY 1)""")
def _(p):
    found = namespace.read_identities(_identities(p)).where("error IS NULL AND disk_id % 23 <> 0 AND pool_id <> 4")
    return namespace.assemble(p.disks().select((F.col("disk_id") % 10).alias("pool_id"), "disk_id"), found)


@query("src13_config", "", """SELECT s_suppkey AS node, CASE WHEN e IS NULL THEN 'pool' || s_suppkey % 9 END AS pool_name, CAST(CASE WHEN e IS NULL THEN CASE WHEN s_suppkey % 2 = 0 THEN 7000 ELSE 30000 END END AS BIGINT) AS read_timeout_ms, CASE WHEN e IS NULL THEN CASE WHEN s_suppkey % 3 = 0 THEN '/named/journal.bin' ELSE '/var/lib/extentlake/journal.bin' END END AS journal_path, e AS error
FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'parse config' WHEN s_suppkey % 7 = 0 THEN 'pool-name must not contain path separators' WHEN s_suppkey % 11 = 0 THEN 'metadata-path must be absolute' WHEN s_suppkey % 13 = 0 THEN 'read-rate-limit-per-second must be positive' END AS e FROM supplier)""")
def _(p):
    k = F.col("s_suppkey")
    name = F.concat(F.lit("pool"), (k % 9).cast("string"), F.when(k % 7 == 0, "/x").otherwise(""))
    text = F.concat(
        F.lit('[global]\npool-name = "'), name, F.lit('"\n'), F.when(k % 11 == 0, 'metadata-path = "here"\n').otherwise(""),
        F.when(k % 2 == 0, "[server]\nread-timeout-seconds = 7\n").otherwise(""), F.when(k % 13 == 0, "[limits]\nread-rate-limit-per-second = 0\n").otherwise(""),
        F.when(k % 3 == 0, '[[pools]]\nname = "own"\njournal-path = "/named/journal.bin"\n').otherwise(""), F.when(k % 5 == 0, "no toml").otherwise(""),
    )
    return config.loaded(p.table("supplier").select(k.alias("node"), F.lit("own").alias("pool"), text.alias("text")))


@query("src20_commands", "", """SELECT event_id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_type END AS op, CASE WHEN event_id % 17 = 0 THEN NULL ELSE user_id END AS disk, CASE WHEN event_id % 17 = 0 THEN 1001 ELSE 0 END AS error_code FROM events""")
def _(p):
    line = F.to_json(F.struct(F.col("event_type").alias("op"), F.struct(F.col("user_id").alias("disk")).alias("params")))
    e = p.table("events").select("event_id", F.when(F.col("event_id") % 17 == 0, F.substring(line, 1, 9)).otherwise(line).alias("line"))
    return requests.commands(e)


@query("agg26_operations", "", "SELECT * FROM (VALUES ('data', 4), ('info', 6), ('io', 5), ('maintenance', 5), ('metrics', 7), ('recovery', 6)) AS t(category, n) UNION ALL SELECT 'total', 33")
def _(p):
    return requests.operations(p.spark)


# Predicates, orders, sets


@query("fil05_extents_on_disk", "ext", "SELECT extent_no FROM ext WHERE data_disk = 3 OR mirror_disk = 3")
def _(p):
    return mutations.on_disk(p.extents(), 3).select("extent_no")


@query("fil19_healthy_disks", "", "SELECT s_suppkey AS disk_id, s_suppkey % 5 IN (0, 1) AS healthy FROM supplier")
def _(p):
    status = F.get(F.array(*[F.lit(x) for x in ("ok", "suspect", "failing", "failed", "excluded")]), (F.col("s_suppkey") % 5).cast("int"))
    return p.table("supplier").select(F.col("s_suppkey").alias("disk_id"), C.is_healthy(status).alias("healthy"))


@query("fil12_protection_lookup", "ext", "SELECT extent_no, CASE extent_no % 5 WHEN 0 THEN 'checksum_only' WHEN 1 THEN 'mirrored' ELSE 'parity' END AS class FROM ext WHERE file_id % 9 = 0")
def _(p):
    k = F.col("extent_no") % 5
    x = p.extents().withColumn("protection_class", F.when(k == 0, "").when(k == 1, "mirrored").otherwise("parity"))
    return x.join(p.files().where("file_id % 9 = 0").select("file_id"), "file_id", "left_semi").select("extent_no", C.extent_class(F.col("protection_class")).alias("class"))


@query("srt03_rebuild_order", "ext", "SELECT extent_no, row_number() OVER (PARTITION BY data_disk ORDER BY pg, logical_offset, extent_no) AS rank FROM ext")
def _(p):
    return p.extents().select("extent_no", F.row_number().over(W.partitionBy("data_disk").orderBy("pg", "logical_offset", "extent_no")).cast("long").alias("rank"))


@query("srt04_parity_order", "ext", "SELECT pg, string_agg(CAST(extent_no AS VARCHAR), ',' ORDER BY logical_offset, extent_no) AS members FROM ext GROUP BY pg")
def _(p):
    members = F.array_sort(F.collect_list(F.struct("logical_offset", "extent_no"))).getField("extent_no").cast("array<string>")
    return p.extents().groupBy("pg").agg(F.array_join(members, ",").alias("members"))


@query("srt02_group_order", "ext groups", "SELECT pg, row_number() OVER (PARTITION BY parity_disk ORDER BY pg) AS rank FROM groups")
def _(p):
    return p.groups().select("pg", F.row_number().over(W.partitionBy("parity_disk").orderBy("pg")).cast("long").alias("rank"))


@query("srt10_disk_order", "disks", "SELECT disk_id, row_number() OVER (ORDER BY CAST(disk_id AS VARCHAR)) AS rank FROM disks")
def _(p):
    """Disks are a dimension of bounded size, so one window may order them all."""
    return p.disks().select("disk_id", F.row_number().over(W.orderBy(F.col("disk_id").cast("string"))).cast("long").alias("rank"))


@query("set02_remove_extents", "ext", """SELECT pg, coalesce(string_agg(CAST(extent_no AS VARCHAR), ',' ORDER BY extent_no) FILTER (extent_no % 3 <> 0), '') AS members, CAST(coalesce(sum(length) FILTER (extent_no % 3 = 0), 0) AS BIGINT) AS freed FROM ext GROUP BY pg""")
def _(p):
    x = p.extents()
    groups = x.groupBy("pg").agg(F.sort_array(F.collect_list("extent_no")).alias("members"))
    out = mutations.without_extents(groups, x.where("extent_no % 3 = 0"))
    return out.select("pg", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), "freed")


@query("set05_remove_disk", "disks", "SELECT disk_id, role FROM disks WHERE disk_id <> 3")
def _(p):
    return p.disks().where(F.col("disk_id") != 3).select("disk_id", "role")


# Functions of paths, texts and states


@query("fn16_paths", "ext", r"""SELECT extent_no, printf('/pool/mirror/m%d/data/ab/cd/extent-%06d.bin.mirror.bin', mirror_disk, extent_no) AS mirror, printf('data/di/sk/extent-%06d.bin', extent_no) AS relocated FROM ext""")
def _(p):
    path = F.format_string("data/ab/cd/extent-%06d.bin", "extent_no")
    return p.extents().select("extent_no", C.mirror_path(F.lit("/pool"), path, F.concat(F.lit("m"), F.col("mirror_disk").cast("string"))).alias("mirror"), C.relocated_path(path, F.lit("disk-07")).alias("relocated"))


@query("fn21_fn25_texts", "", """SELECT s_suppkey AS id, 'tx-write-' || s_suppkey AS tx_id, contains(s_name, '#') OR contains(s_name, ':') AS odd, s_suppkey * 1000 AS timeout_ms, CASE WHEN s_suppkey % 3 = 0 THEN 'second' ELSE 'first; second' END AS errors,
  CASE WHEN s_suppkey % 5 = 0 THEN 'draining' WHEN s_suppkey % 3 = 0 THEN 'error' WHEN s_suppkey % 2 = 0 THEN 'degraded' ELSE 'ok' END AS health FROM supplier""")
def _(p):
    k = F.col("s_suppkey")
    admission = F.when(k % 3 == 0, "refuse").when(k % 2 == 0, "degraded").otherwise("ok")
    return p.table("supplier").select(
        k.alias("id"), C.tx_id("tx-write", k).alias("tx_id"), C.contains_any(F.col("s_name"), "#:").alias("odd"), C.milliseconds(k).alias("timeout_ms"),
        C.joined_errors(F.when(k % 3 == 0, "").otherwise("first"), F.lit("second")).alias("errors"), C.health_status(k % 5 == 0, admission).alias("health"),
    )


@query("fn26_snapshot_digest", "ext", """SELECT file_id, sha256(string_agg(extent_no || ':' || length || ':' || data_disk, chr(10) ORDER BY extent_no)) AS digest FROM ext GROUP BY file_id""")
def _(p):
    return rollup.snapshot_digest(p.extents(), "file_id", "extent_no", ["extent_no", "length", "data_disk"])


@query("fn15_extent_path_blake3")
def _(p):
    x = p.extents().select("extent_no", "file_id").join(p.files().select("file_id", "path"), "file_id")
    return x.select("extent_no", F.col("path").alias("file"), C.extent_path_blake3(F.col("path"), F.col("extent_no")).alias("path"))


# Sinks


@query("snk09_journal_export", "journal", """t AS (SELECT tx, arg_max(state, seq) AS last FROM journal GROUP BY tx)
--
SELECT count(*) FILTER (last NOT IN ('committed', 'aborted')) > 0 AS requires_replay, (SELECT count(*) FROM journal) AS total_records, count(*) FILTER (last NOT IN ('committed', 'aborted')) AS incomplete_txs FROM t""")
def _(p):
    return wal.export(p.journal())


@query("snk10_backup", "ext files disks", "SELECT 'disks' AS name, count(*) AS rows, 'v1' AS version FROM disks UNION ALL SELECT 'extents', count(*), 'v1' FROM ext UNION ALL SELECT 'files', count(*), 'v1' FROM files")
def _(p):
    """A backup that was written, restored and counted again."""
    path = tables.shared_path(p.spark, "backup")
    tables.backup({"files": p.files(), "extents": p.extents(), "disks": p.disks()}, path, "v1")
    out = None
    for name, df in tables.restore(p.spark, path).items():
        n = df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.lit("v1").alias("version"))
        out = n if out is None else out.unionByName(n)
    return out


@query("snk11_audit_log", "", "SELECT event_type AS operation, 'u' || user_id AS user, CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS result, CAST(event_id AS VARCHAR) AS details FROM events")
def _(p):
    path = tables.shared_path(p.spark, "audit")
    e = p.table("events").select(F.lit("2024-01-01T00:00:00Z").alias("timestamp"), F.col("event_type").alias("operation"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user"), F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("result"), F.col("event_id").cast("string").alias("details"))
    for half in (0, 1):
        tables.log_events(e.where(F.col("details").cast("long") % 2 == half), path)
    return tables.read_events(p.spark, path).drop("timestamp")


@query("src04_src17_default_catalog", "", "SELECT * FROM (VALUES ('disk-01', 'data', 'online'), ('disk-02', 'data', 'online'), ('disk-parity', 'parity', 'online'), ('disk-meta', 'metadata', 'online')) AS t(disk_id, role, health_status)")
def _(p):
    path = tables.shared_path(p.spark, "catalog")
    tables.load_or_create(p.spark, path, tables.prototype_disks(p.spark))
    again = tables.load_or_create(p.spark, path, tables.prototype_disks(p.spark).limit(0))
    return again.select("disk_id", "role", "health_status")


# Bulk requests, migration, exclusion, reads after recovery


@query("adm02_bulk_read", "ext", f"""h AS (SELECT file_id, {_REASON} IS NULL AS sound FROM ext), f AS (SELECT file_id, bool_and(sound) AS ok FROM h GROUP BY file_id)
--
SELECT o_orderkey AS request, CASE WHEN o_orderkey % 4 = 0 THEN 'file not found' WHEN ok IS NULL THEN 'no extents' WHEN NOT ok THEN 'lost extent' END AS error FROM orders LEFT JOIN f ON file_id = o_orderkey WHERE o_orderkey % 3 = 0""")
def _(p):
    """Reads of many files in one pass, without parity to heal from."""
    wanted = p.files().where("file_id % 3 = 0").select(F.col("file_id").alias("request"), F.when(F.col("file_id") % 4 == 0, -1).otherwise(F.col("file_id")).alias("file_id"))
    some = _catalog(p).join(wanted.select("file_id"), "file_id", "left_semi")
    judged = p.stored("verdicts", blobs_io.verdicts(some, _blobs))
    sizes = judged.groupBy("file_id").agg(F.sum("length").alias("size_bytes"))
    none = judged.where("false").select("extent_no", F.lit(b"").alias("content"))
    read = blobs_io.read_files(sizes, judged, _blobs, none).select("file_id", F.col("error").alias("e"), F.lit(True).alias("has"))
    error = F.when(F.col("file_id") == -1, "file not found").when(F.col("has").isNull(), "no extents").otherwise(F.col("e"))
    return wanted.join(read, "file_id", "left").select("request", error.alias("error"))


@query("rec08_migrate_disk", "ext", f"""v AS (SELECT extent_no, {_REASON} AS reason, pg % 83 <> 0 AND count({_REASON}) OVER (PARTITION BY pg) = 1 AS can, data_disk FROM ext)
--
SELECT 3 AS disk_id, count(*) AS scanned, count(*) FILTER (reason IS NOT NULL AND can) AS rebuilt, count(*) FILTER (reason IS NOT NULL AND NOT can) AS failed FROM v WHERE data_disk = 3""")
def _(p):
    from .catalog import _verdicts

    none = p.extents().where("false").select("extent_no")
    plan = recovery.rebuild_plan(_verdicts(p).where("data_disk = 3"), none)
    return plan.select(F.col("disk_id").cast("int").alias("disk_id"), "scanned", "rebuilt", "failed")


@query("str09_auto_exclusion", "ext disks", """RECURSIVE r AS (SELECT user_id AS disk, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT DISTINCT disk, CAST(0 AS BIGINT) AS i, 'ok' AS status, CAST(0 AS BIGINT) AS failures FROM r
  UNION ALL SELECT r.disk, r.i, CASE WHEN failed THEN CASE WHEN failures + 1 >= 3 THEN 'failing' ELSE 'suspect' END WHEN failures - CAST(failures > 0 AND status = 'suspect' AS BIGINT) = 0 THEN 'ok' ELSE status END,
    CASE WHEN failed THEN failures + 1 ELSE failures - CAST(failures > 0 AND status = 'suspect' AS BIGINT) END
  FROM f JOIN r ON r.disk = f.disk AND r.i = f.i + 1),
z AS (SELECT disk FROM f GROUP BY disk HAVING arg_max(status, i) = 'failing')
--
SELECT disk_id, (SELECT count(*) FROM ext WHERE data_disk = disk_id OR mirror_disk = disk_id) AS to_move FROM disks JOIN z ON disk = disk_id WHERE role = 'data'""")
def _(p):
    health = state.final_health(p.samples().select("disk", "ts", "event_id", (F.col("event_type") == "error").alias("failed")))
    return mutations.exclusions(p.disks(), health, p.extents())


@query("str10_recover_before_read", "journal", """t AS (SELECT tx, arg_max(state, seq) AS last, arg_max(state, seq) FILTER (state <> 'replay-required') AS worked, arg_max(repair, seq) AS repair FROM journal GROUP BY tx),
e AS (SELECT tx, repair, CASE WHEN last = 'replay-required' THEN worked ELSE last END AS s FROM t)
--
SELECT tx AS file_id, s <> 'committed' AS recovered FROM e WHERE NOT repair AND s IN ('committed', 'data-written', 'parity-written', 'metadata-written')""")
def _(p):
    return wal.visible(wal.recovery_plan(p.journal())).select(F.col("tx").alias("file_id"), "recovered")


@query("adm09_adm10_faults", "ext", "SELECT extent_no, CASE extent_no % 3 WHEN 0 THEN substr(h, 1, 60) WHEN 1 THEN 'x' || substr(h, 2) ELSE h END AS hex FROM (SELECT extent_no, sha256(CAST(extent_no AS VARCHAR)) AS h FROM ext) WHERE extent_no % 5 <> 0")
def _(p):
    """Blobs lost, cut, and flipped and flipped back; the first digit is marked where the flip changed it."""
    k = F.col("extent_no")
    blobs = p.extents().select("extent_no", F.sha2(k.cast("string"), 256).cast("binary").alias("content"))
    blobs = faults.damaged(faults.lost(blobs, k % 5 == 0), k % 3 == 0, lambda c: faults.cut(c, 4))
    flipped = faults.flipped(F.col("content"), 0)
    changed = (flipped != F.col("content")) & (faults.flipped(flipped, 0) == F.col("content"))
    mark = F.when((k % 3 == 1) & changed, F.concat(F.lit(b"x"), F.substr("content", F.lit(2), F.octet_length("content")))).otherwise(F.col("content"))
    return blobs.select("extent_no", mark.cast("string").alias("hex"))
