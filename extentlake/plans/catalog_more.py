"""More of the catalogue: requests, blobs, lifecycle, merges, exports. Importing it adds to ``catalog``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import blobs
from ..functions import columns as C
from ..operators import maintenance, requests, rollup, wal
from .catalog import query

# Predicates and projections


@query("fil06_online_data_disks", "disks", "SELECT disk_id FROM disks WHERE role = 'data' AND health = 'online' AND disk_id <> 4")
def _(p):
    return p.disks().where((F.col("role") == "data") & (F.col("health") == "online") & (F.col("disk_id") != 4)).select("disk_id")


@query("fil09_fil10_record_kinds", "", """SELECT o_orderkey AS tx, CASE o_orderkey % 5 WHEN 0 THEN 'extent' WHEN 1 THEN 'parity' WHEN 2 THEN 'scrub' WHEN 3 THEN 'rebuild' ELSE '' END AS kind FROM orders""")
def _(p):
    k = F.col("o_orderkey") % 5
    path = F.when(k == 0, "repair://extent/x").when(k == 1, "repair://parity/x").when(k == 2, "metadata://scrub/x").when(k == 3, "metadata://rebuild/x").otherwise("repair://extent/y")
    return p.table("orders").select(F.col("o_orderkey").alias("tx"), requests.record_kind(path, k == 4, F.when(k < 2, 1).otherwise(0)).alias("kind"))


@query("fil13_missing_errors", "", """SELECT o_custkey AS pool, count(*) > 0 AND bool_and(o_orderkey % 7 <> 0) AS recoverable FROM orders GROUP BY o_custkey""")
def _(p):
    e = F.when(F.col("o_orderkey") % 7 != 0, "extent: file missing or unreadable").otherwise("bad magic")
    return p.table("orders").groupBy(F.col("o_custkey").alias("pool")).agg(((F.count("*") > 0) & F.bool_and(e.contains("file missing or unreadable"))).alias("recoverable"))


@query("fil14_affected_ids", "ext", "SELECT file_id, string_agg(CAST(extent_no AS VARCHAR), ',' ORDER BY extent_no) AS ids FROM ext GROUP BY file_id")
def _(p):
    return p.extents().groupBy("file_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("extent_no")), lambda v: v.cast("string")), ",").alias("ids"))


@query("fil15_write_requests", "", """SELECT o_orderkey AS request, CASE WHEN o_orderkey % 11 = 0 THEN 'path required' WHEN o_orderkey % 13 = 0 AND o_orderkey % 3 = 0 THEN 'negative size' WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 1 THEN 'payload required' WHEN o_orderkey % 17 = 0 THEN 'unsupported codec' END AS error FROM orders""")
def _(p):
    k = F.col("o_orderkey")
    e = requests.write_error(F.when(k % 11 == 0, "").otherwise("/x"), F.when(k % 13 == 0, -1).otherwise(1), k % 3 != 0, k % 2 == 0, F.when(k % 17 == 0, "brotli").otherwise("zstd"))
    return p.table("orders").select(k.alias("request"), e.alias("error"))


@query("fil17_maintenance_hour", "", "SELECT event_id FROM events WHERE hour(ts) >= 2 AND hour(ts) < 5")
def _(p):
    return p.table("events").where((F.hour("ts") >= 2) & (F.hour("ts") < 5)).select("event_id")


@query("fil20_names_and_paths", "", r"""SELECT s_suppkey AS id, regexp_full_match(s_name, '[a-z0-9_ -]{1,64}') AS valid, CASE s_suppkey % 5 WHEN 0 THEN 'absolute' WHEN 1 THEN 'not canonical' WHEN 2 THEN 'traversal' WHEN 3 THEN 'not canonical' END AS error FROM supplier""")
def _(p):
    k = F.col("s_suppkey") % 5
    path = F.when(k == 0, "/data/x").when(k == 1, "data//x").when(k == 2, "../x").when(k == 3, "data/../x").otherwise("data/x.bin")
    return p.table("supplier").select(F.col("s_suppkey").alias("id"), requests.valid_pool_name(F.col("s_name")).alias("valid"), requests.path_error(path).alias("error"))


# Joins and merges


@query("join04_scrub_order", "ext files", "SELECT extent_no, coalesce(path, '') AS path, logical_offset FROM ext LEFT JOIN (SELECT * FROM files WHERE file_id % 97 <> 0) AS f USING (file_id)")
def _(p):
    x = p.extents().select("extent_no", "file_id", "logical_offset")
    return x.join(p.files().where("file_id % 97 <> 0").select("file_id", "path"), "file_id", "left").select("extent_no", F.coalesce("path", F.lit("")).alias("path"), "logical_offset")


@query("join07_missing_disks", "disks", "SELECT disk_id FROM disks WHERE disk_id % 23 = 0")
def _(p):
    d = p.disks().select("disk_id")
    return d.join(d.where("disk_id % 23 <> 0"), "disk_id", "left_anti")


@query("join09_touched_inputs", "ext", "SELECT extent_no FROM ext WHERE pg IN (SELECT pg FROM ext WHERE extent_no % 50 = 7) AND extent_no % 50 <> 7")
def _(p):
    x = p.extents().select("extent_no", "pg")
    return maintenance.touched_extents(x, x.where("extent_no % 50 = 7")).select("extent_no")


@query("join16_checksum_diff", "ext", "SELECT pg, bool_or(extent_no % 90 = 0) AS changed FROM ext GROUP BY pg")
def _(p):
    x = p.extents().groupBy("pg").agg(F.min("extent_no").alias("lo"), F.bool_or(F.col("extent_no") % 90 == 0).alias("hit"))
    before, after = x.select("pg", F.sha2(F.col("lo").cast("string"), 256).alias("b")), x.select("pg", F.sha2(F.concat(F.col("lo").cast("string"), F.when(F.col("hit"), "x").otherwise("")), 256).alias("a"))
    return after.join(before, "pg", "left").select("pg", (F.col("a") != F.coalesce("b", F.lit(""))).alias("changed"))


@query("join17_update_checksums", "ext", "SELECT extent_no, CASE WHEN extent_no % 9 = 0 THEN 'new' ELSE 'old' END AS checksum FROM ext")
def _(p):
    x = p.extents().select("extent_no", F.lit("old").alias("checksum"))
    return maintenance.updated(x, x.where("extent_no % 9 = 0").withColumn("checksum", F.lit("new")), "extent_no", "checksum").select("extent_no", "checksum")


@query("join18_replace_disk", "ext", "SELECT CASE data_disk WHEN 3 THEN 1000003 ELSE data_disk END AS data_disk, count(*) AS n FROM ext GROUP BY 1")
def _(p):
    x = p.table("lineitem").select(F.col("l_suppkey").alias("data_disk"))
    return maintenance.replace_disk(x, 3, 1000003).groupBy("data_disk").agg(F.count("*").alias("n"))


@query("join20_stale_parity", "ext", "SELECT DISTINCT pg FROM ext WHERE file_id % 12 = 0 AND (pg % 5 = 0 OR pg % 7 = 0 OR pg % 11 = 0)")
def _(p):
    g = p.extents().select("pg", "file_id")
    one = g.select("pg").distinct()
    stored = one.where("pg % 5 <> 0").select("pg", F.col("pg").cast("string").alias("stored"))
    found = one.where("pg % 7 <> 0").select("pg", F.when(F.col("pg") % 11 == 0, "bad").otherwise(F.col("pg").cast("string")).alias("found"))
    return maintenance.stale_parity(stored, found, g.where("file_id % 12 = 0"))


@query("join22_targeted_check", "ext", "SELECT CAST(extent_no AS VARCHAR) AS entity, 'E3' AS code FROM ext WHERE extent_no % 307 = 0 AND file_id % 2 = 0")
def _(p):
    x = p.extents()
    bad = x.where("extent_no % 307 = 0").select(F.col("extent_no").cast("string").alias("entity"), F.lit("E3").alias("code"))
    return maintenance.targeted(bad, x.where("file_id % 2 = 0").select(F.col("extent_no").alias("entity"))).select("entity", "code")


@query("join23_mountpoints", "ext disks", "SELECT extent_no, coalesce('/mnt/d' || disk_id, '/pool') AS mountpoint FROM ext LEFT JOIN (SELECT * FROM disks WHERE role <> 'metadata') AS d ON disk_id = data_disk")
def _(p):
    d = p.disks().where("role <> 'metadata'").select(F.col("disk_id").alias("data_disk"), F.concat(F.lit("/mnt/d"), F.col("disk_id").cast("string")).alias("m"))
    return p.extents().select("extent_no", "data_disk").join(d, "data_disk", "left").select("extent_no", F.coalesce("m", F.lit("/pool")).alias("mountpoint"))


# Rollups


@query("agg08_status", "ext files disks journal", """t AS (SELECT tx, arg_max(state, seq) AS last, arg_max(state, seq) FILTER (state <> 'replay-required') AS worked, arg_max(repair, seq) AS repair FROM journal GROUP BY tx),
e AS (SELECT repair, last, CASE WHEN last = 'replay-required' THEN worked ELSE last END AS s FROM t)
--
SELECT CASE WHEN (SELECT count(*) FROM disks WHERE health = 'failed') > 0 THEN 'degraded' ELSE 'ok' END AS status, (SELECT count(*) FROM files) AS managed_files, (SELECT count(*) FROM ext) AS allocated_extents, (SELECT count(*) FROM journal) AS journal_records,
  count(*) FILTER (s NOT IN ('committed', 'aborted')) > 0 AS journal_requires_replay, count(*) FILTER (s NOT IN ('committed', 'aborted') AND (repair OR s <> 'prepared')) AS recovered_transactions, count(*) FILTER (NOT repair AND s = 'prepared') AS aborted_transactions,
  (SELECT string_agg(CAST(disk_id AS VARCHAR), ',' ORDER BY disk_id) FROM disks WHERE health NOT IN ('', 'online')) AS failed_disks, (SELECT count(*) FROM ext WHERE extent_no % 307 = 0) AS invariant_violations FROM e""")
def _(p):
    from ..operators import checks

    x = p.extents().select("extent_no", F.when(F.col("extent_no") % 307 == 0, -F.col("length")).otherwise(F.col("length")).alias("length"))
    admission = wal.admission(p.disks().where("health = 'failed'").select(F.lit(False).alias("hard")))
    return rollup.status(p.disks(), p.files(), p.table("lineitem").select("l_orderkey"), p.journal(), wal.recovery_plan(p.journal()), checks.positive_length(x), admission)


@query("agg09_recovery_status", "journal", """t AS (SELECT tx, arg_max(state, seq) AS last, arg_max(state, seq) FILTER (state <> 'replay-required') AS worked, arg_max(repair, seq) AS repair FROM journal GROUP BY tx),
e AS (SELECT repair, CASE WHEN last = 'replay-required' THEN worked ELSE last END AS s FROM t)
--
SELECT count(*) FILTER (s NOT IN ('committed', 'aborted')) AS attempted, count(*) FILTER (s NOT IN ('committed', 'aborted') AND (repair OR s <> 'prepared')) AS recovered,
  count(*) FILTER (NOT repair AND s = 'prepared') AS aborted, (SELECT count(*) FROM journal) AS records FROM e""")
def _(p):
    return rollup.recovery_counts(wal.recovery_plan(p.journal()), p.journal())


@query("agg13_tx_groups", "journal", "SELECT tx, string_agg(state, '>' ORDER BY seq) AS states, min(seq) AS first_seq FROM journal GROUP BY tx")
def _(p):
    states = F.array_sort(F.collect_list(F.struct("seq", "state")))
    return p.journal().groupBy("tx").agg(F.array_join(states.getField("state"), ">").alias("states"), F.min("seq").alias("first_seq"))


@query("agg25_simulator", "", """m AS (SELECT d, e, j, CAST('0x' || substr(sha256('7|' || d || '|' || e), CAST(8 * j + 1 AS INT), 8) AS BIGINT) AS word FROM unnest(range(3)) AS a(d), unnest(range(8)) AS b(e), unnest(range(8)) AS c(j)),
n AS (SELECT *, CASE WHEN d = 1 AND e = 3 AND j = 0 THEN xor(word, 255) ELSE word END AS now FROM m),
s AS (SELECT e, j, bit_xor(word) AS parity, bit_xor(now) AS total FROM n GROUP BY e, j),
p AS (SELECT d, e, bool_or(now <> word) AS bad, bool_and(xor(xor(parity, total), now) = word) AS can FROM n JOIN s USING (e, j) GROUP BY d, e)
--
SELECT count(*) FILTER (bad) AS mismatches, count(*) FILTER (bad AND can) AS recoveries, bool_and(NOT bad OR can) AS all_healthy FROM p""")
def _(p):
    return maintenance.simulate(maintenance.simulator(3, 8, p.spark), 1, 3)


@query("srt06_placement_rank", "ext disks", """load AS (SELECT data_disk, count(*) AS n FROM ext GROUP BY data_disk)
--
SELECT arg_min(disk_id, {'a': coalesce(n, 0), 'b': -free, 'c': disk_id}) AS disk_id FROM disks LEFT JOIN load ON data_disk = disk_id WHERE role = 'data' AND lower(health) = 'online' AND free > 0""")
def _(p):
    d = p.disks().where((F.col("role") == "data") & (F.lower("health") == "online") & (F.col("free") > 0))
    load = rollup.disk_load(d, p.table("lineitem").select(F.col("l_suppkey").alias("data_disk")))
    return d.join(load, "disk_id").agg(F.min_by("disk_id", F.struct("n", -F.col("free"), "disk_id")).alias("disk_id"))


# Journal and lifecycle


@query("wal09_j3_flags", "", "SELECT 'J3' AS code, 'journal' AS kind, CAST(o_orderkey AS VARCHAR) AS entity FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 5 = 0")
def _(p):
    # The catalog's transactions, not the journal's: the flag is what recovery leaves behind.
    t = p.table("orders").select(F.col("o_orderkey").alias("tx"), ((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 5 == 0)).alias("replay_required"))
    return wal.replay_flags(t)


@query("wal11_readiness", "", "SELECT o_orderkey AS node, CASE WHEN o_orderkey % 5 = 0 THEN 'draining' WHEN o_orderkey % 3 = 0 THEN 'startup refused' WHEN o_orderkey % 7 = 0 THEN 'startup error' WHEN o_orderkey % 2 = 0 THEN 'journal requires replay' ELSE 'ready' END AS state FROM orders")
def _(p):
    k = F.col("o_orderkey")
    return p.table("orders").select(k.alias("node"), wal.readiness(k % 5 == 0, F.when(k % 3 == 0, "refuse").otherwise("ok"), F.when(k % 7 == 0, "x").otherwise(""), k % 2 == 0).alias("state"))


@query("wal_state_codes", "journal", "SELECT tx, seq, CAST(list_position(['prepared', 'data-written', 'parity-written', 'metadata-written', 'committed', 'aborted', 'replay-required'], state) AS BIGINT) AS code FROM journal")
def _(p):
    return p.journal().select("tx", "seq", wal.state_code(F.col("state")).cast("long").alias("code"))


@query("plc04_fail_disk", "disks", "SELECT CASE WHEN disk_id = 2 THEN 'failed' ELSE health END AS health, count(*) AS n FROM disks GROUP BY 1")
def _(p):
    return maintenance.fail_disk(p.disks(), 2).groupBy("health").agg(F.count("*").alias("n"))


# Functions


@query("fn03_fn04_blob_lengths", "", """SELECT s_suppkey AS id, rpad(substr(s_name, 1, CAST(s_suppkey % 30 AS INT)), CAST(s_suppkey % 30 AS INT), '~') AS cut, rpad(substr(s_name, 5, 20), 20, '~') AS slice FROM supplier""")
def _(p):
    raw, text = F.col("s_name").cast("binary"), lambda c: F.translate(c.cast("string"), "\0", "~")
    k = F.col("s_suppkey")
    return p.table("supplier").select(k.alias("id"), text(blobs.with_length(raw, k % 30)).alias("cut"), text(blobs.slice_of(raw, F.lit(4), F.lit(20))).alias("slice"))


@query("fn06_codecs", "", "SELECT s_suppkey AS id, s_name AS name FROM supplier")
def _(p):
    k = F.col("s_suppkey") % 6
    codec = F.get(F.array(*[F.lit(c) for c in blobs.CODEC_IDS]), k.cast("int"))
    frame = blobs.compress_column(F.col("s_name").cast("binary"), codec)
    return p.table("supplier").select(F.col("s_suppkey").alias("id"), blobs.decompress_column(frame).cast("string").alias("name"))


@query("fn08_compression_ratio", "ext", "SELECT extent_no, CASE WHEN extent_no % 10 = 0 THEN 1000 ELSE CAST(round(1000.0 * (length // 4) / length) AS INT) END AS permille FROM ext")
def _(p):
    packed = F.when(F.col("extent_no") % 10 == 0, 0).otherwise(F.floor(F.col("length") / 4))
    return p.extents().select("extent_no", F.round(blobs.ratio(F.col("length"), packed) * 1000).cast("int").alias("permille"))


@query("fn13_defaults", "", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'integrity_only' ELSE 'parity' END AS level, CASE WHEN s_suppkey % 2 = 0 THEN 'checksum_only' ELSE 'mirrored' END AS cls FROM supplier")
def _(p):
    k = F.col("s_suppkey")
    blank = lambda v: F.when(k % 2 == 0, "").otherwise(v)
    return p.table("supplier").select(k.alias("id"), C.protection_level(blank("parity")).alias("level"), C.extent_class(blank("mirrored")).alias("cls"))


@query("fn18_path_parts", "files", "SELECT file_id, string_split(path, '/')[-1] AS base, left(path, length(path) - length(string_split(path, '/')[-1]) - 1) AS parent FROM files")
def _(p):
    base = F.substring_index("path", "/", -1)
    return p.files().select("file_id", base.alias("base"), F.expr("left(path, length(path) - length(substring_index(path, '/', -1)) - 1)").alias("parent"))


@query("src18_synthetic_bytes", "ext", "SELECT extent_no, CASE WHEN n <= 64 THEN substr(a, 1, n) ELSE substr(a || sha256(a), 1, n) END AS hex FROM (SELECT extent_no, CAST(length // 4096 % 60 + 40 AS INT) AS n, sha256(extent_no || '|' || file_id) AS a FROM ext)")
def _(p):
    n = (F.col("length") / 4096).cast("long") % 60 + 40
    return p.extents().select("extent_no", blobs.synthetic_hex(F.concat_ws("|", F.col("extent_no").cast("string"), F.col("file_id").cast("string")), n).alias("hex"))


# Sinks and the command surface


@query("snk02_encoding_limits", "", "SELECT s_suppkey AS id, 'long' AS field FROM supplier WHERE s_suppkey % 10 = 0")
def _(p):
    s = p.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("short"), F.repeat(F.lit("x"), F.when(F.col("s_suppkey") % 10 == 0, 65536).otherwise(65535)).alias("long"))
    return requests.encoding_violations(s, "id", ["short", "long"])


@query("snk08_json_export", "disks", "SELECT disk_id, '{\"disk_id\":' || disk_id || ',\"role\":\"' || role || '\",\"health\":\"' || health || '\"}' AS json FROM disks")
def _(p):
    return requests.catalog_json(p.disks())


@query("snk12_log_levels", "", "SELECT event_id FROM events WHERE event_id % 5 IN (2, 3)")
def _(p):
    level = F.get(F.array(*[F.lit(x) for x in ("debug", "info", "warn", "error", "trace")]), (F.col("event_id") % 5).cast("int"))
    return requests.logged(p.table("events").select("event_id", level.alias("level")), "warn").select("event_id")


@query("snk13_exposition", "", """SELECT string_agg('# HELP pool_' || event_type || ' Events seen' || chr(10) || '# TYPE pool_' || event_type || ' counter' || chr(10) || 'pool_' || event_type || ' ' || n, chr(10) ORDER BY event_type) AS text FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)""")
def _(p):
    m = p.table("events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("value"))
    return requests.exposition(m.withColumns({"help": F.lit("Events seen"), "kind": F.lit("counter")}), "pool")


@query("snk15_health_report", "disks", """SELECT '=== Pool Health Report ===' || chr(10) || chr(10) || string_agg('Disk: ' || disk_id || chr(10) || '  Status: ' || health || chr(10) || '  Failures: ' || disk_id % 4 || chr(10) || '  Last Check: 2024-01-02T03:04:05Z' || chr(10)
  || CASE WHEN disk_id % 3 = 0 THEN '  Last Error: timeout' || chr(10) ELSE '' END || CASE WHEN disk_id % 2 = 0 THEN '  Temperature: ' || disk_id % 50 || '°C' || chr(10) || '  Reallocated Sectors: ' || disk_id % 7 || chr(10) || '  Power On Hours: ' || disk_id * 24 || chr(10) ELSE '' END || chr(10), '' ORDER BY disk_id) AS report FROM disks""")
def _(p):
    k = F.col("disk_id")
    smart = F.when(k % 2 == 0, F.struct((k % 50).alias("celsius"), (k % 7).alias("reallocated"), (k * 24).alias("hours")))
    d = p.disks().select("disk_id", F.col("health").alias("status"), (k % 4).alias("failures"), F.lit("2024-01-02 03:04:05").cast("timestamp").alias("checked"), F.when(k % 3 == 0, "timeout").otherwise("").alias("error"), smart.alias("smart"))
    return requests.health_report(d)


@query("adm01_batches", "", """SELECT user_id AS batch_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS seq, CASE event_type WHEN 'error' THEN 1005 ELSE 0 END AS error_code, event_id % 100 > 90 AS slow FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) <= 100)
UNION ALL SELECT user_id, -1, 1003, false FROM events GROUP BY user_id HAVING count(*) > 100""")
def _(p):
    c = F.struct("event_id", F.when(F.col("event_type") == "error", "timeout").alias("error"), F.when(F.col("event_id") % 100 > 90, 9000).otherwise(1).alias("latency_ms"))
    # A batch above the limit is refused by its size; no more than the limit and one is gathered.
    from pyspark.sql import Window as W

    e = p.table("events").withColumn("k", F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))).where(F.col("k") <= requests.MAX_BATCH + 1)
    return requests.batch(e.groupBy(F.col("user_id").alias("batch_id")).agg(F.array_sort(F.collect_list(c)).alias("commands")))
