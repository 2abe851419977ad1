"""The query catalogue: every operator over the projected workload, with equivalent SQL where there is one.

``QUERIES[name](spark, sf_dir)`` gives a DataFrame, ``ORACLES[name]`` DuckDB SQL for the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import checks, mutations, namespace, placement, recovery, rollup, wal, xor
from ..streaming import state
from .workload import Pool, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, tables: str = "", oracle: str | None = None):
    def add(f: Callable[[Pool], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Pool(spark, sf_dir))
        if oracle:
            ORACLES[name] = sql(tables, oracle)
        return f

    return add


# Rollups


@query("agg03_pool_stats", "ext files disks", """
SELECT total_bytes, free_bytes, total_bytes - free_bytes AS used_bytes, (total_bytes - free_bytes) * 10000 // total_bytes AS used_bp, extent_count, extent_bytes, file_count, n_data, n_parity, n_mirror, n_metadata
FROM (SELECT CAST(sum(capacity) AS BIGINT) AS total_bytes, CAST(sum(free) AS BIGINT) AS free_bytes, count(*) FILTER (role = 'data') AS n_data, count(*) FILTER (role = 'parity') AS n_parity,
      count(*) FILTER (role = 'mirror') AS n_mirror, count(*) FILTER (role = 'metadata') AS n_metadata FROM disks),
     (SELECT count(*) AS extent_count, CAST(sum(length) AS BIGINT) AS extent_bytes FROM ext), (SELECT count(*) AS file_count FROM files)""")
def _(p):
    # Length needs no numbering of extents: the rollup reads one column of the fact table.
    x = p.table("lineitem").select((F.col("l_quantity").cast("long") * 4096).alias("length"))
    return rollup.pool_stats(p.disks(), x, p.files())


@query("agg04_disk_stats", "ext disks", """
SELECT disk_id, count(d) AS extents, CAST(coalesce(sum(length), 0) AS BIGINT) AS bytes FROM disks LEFT JOIN (
  SELECT data_disk AS d, length FROM ext UNION ALL SELECT mirror_disk, length FROM ext WHERE mirror_disk <> data_disk) AS x ON d = disk_id GROUP BY disk_id""")
def disk_stats(p):
    x = p.table("lineitem").select((F.col("l_quantity").cast("long") * 4096).alias("length"), F.col("l_suppkey").alias("data_disk"), (F.col("l_partkey") % 10).alias("mirror_disk"))
    return rollup.disk_stats(p.disks(), x)


_CLASS = "CASE extent_no % 5 WHEN 0 THEN '' WHEN 1 THEN 'mirrored' ELSE 'parity' END"
_STATUS = "CASE WHEN extent_no % 101 = 0 THEN 'corrupt' WHEN extent_no % 103 = 0 THEN 'quarantined' ELSE 'ok' END"


@query("agg05_protection_status", "ext disks", f"""
SELECT 'disks_' || role AS metric, CAST(count(*) AS VARCHAR) AS value FROM disks GROUP BY role
UNION ALL SELECT 'extents_' || coalesce(nullif({_CLASS}, ''), 'checksum_only'), CAST(count(*) AS VARCHAR) FROM ext GROUP BY 1
UNION ALL SELECT {_STATUS}, CAST(count(*) AS VARCHAR) FROM ext WHERE {_STATUS} <> 'ok' GROUP BY 1
UNION ALL SELECT 'pool_state', CASE WHEN count(*) = 1 THEN 'integrity_only' WHEN count(*) FILTER (role = 'parity') > 0 THEN 'parity' WHEN count(*) FILTER (role = 'mirror') > 0 THEN 'mirrored' ELSE 'integrity_only' END FROM disks""")
def _(p):
    x = p.extents().select(F.expr(_CLASS).alias("protection_class"), F.expr(_STATUS).alias("corruption_status"))
    return rollup.protection_status(p.disks(), x)


@query("agg06_statfs", "files disks", "SELECT CAST(sum(capacity) AS BIGINT) // 4096 AS blocks, CAST(sum(free) AS BIGINT) // 4096 AS bfree, (SELECT count(*) FROM files) AS files FROM disks")
def _(p):
    return rollup.statfs(p.disks(), p.files())


@query("agg07_health_summary", "disks", """
SELECT failed, degraded, CASE WHEN failed > 0 THEN 'critical' WHEN degraded > 0 THEN 'warning' ELSE 'ok' END AS alert
FROM (SELECT count(*) FILTER (health = 'failed') AS failed, count(*) FILTER (health NOT IN ('', 'online', 'failed')) AS degraded FROM disks)""")
def _(p):
    return rollup.health_summary(p.disks())


@query("agg11_latency_histogram", "samples", f"SELECT CAST(len(list_filter([{', '.join(map(str, C.LATENCY_BOUNDS_US))}], lambda b: b <= micros)) AS INTEGER) AS bucket_idx, count(*) AS n FROM samples GROUP BY 1")
def _(p):
    return rollup.histogram(p.samples())


@query("agg12_counters", "samples", "SELECT event_type, count(*) AS counter, arg_max(micros, {'a': ts, 'b': event_id}) AS gauge FROM samples GROUP BY event_type")
def _(p):
    return rollup.counters(p.samples())


@query("agg16_distinct_disks", "ext", "SELECT DISTINCT data_disk AS disk_id FROM ext")
def _(p):
    return rollup.distinct_disks(p.table("lineitem").select(F.col("l_suppkey").alias("data_disk")))


@query("agg17_disk_load", "ext disks", "SELECT disk_id, count(data_disk) AS n FROM disks LEFT JOIN ext ON data_disk = disk_id GROUP BY disk_id")
def _(p):
    return rollup.disk_load(p.disks(), p.table("lineitem").select(F.col("l_suppkey").alias("data_disk")))


@query("agg18_group_width", "disks", "SELECT least(greatest(count(*) FILTER (role = 'data' AND lower(health) = 'online' AND free > 0), 1), 8) AS width FROM disks")
def _(p):
    return rollup.group_width(p.disks())


@query("agg23_quorum", "disks", "SELECT count(*) FILTER (health <> 'failed') AS present, count(*) AS total, count(*) > 0 AND count(*) FILTER (health <> 'failed') >= count(*) - 1 AS intact FROM disks WHERE role = 'data'")
def _(p):
    return rollup.quorum(p.disks())


#: Runs that a pool's history keeps, as in the reference (maxScrubHistory).
SCRUB_HISTORY = 32


@query("agg28_scrub_history", "", """
SELECT o_orderkey AS run_id, o_custkey AS pool, CASE WHEN o_orderstatus = 'P' THEN 'in_progress' ELSE 'completed' END AS status, CAST(k AS BIGINT) AS k FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k <= 32""")
def _(p):
    from pyspark.sql import Window as W

    # A rank limit per pool: Spark keeps the newest runs in every task before the shuffle.
    o = p.table("orders").withColumn("k", F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))).where(F.col("k") <= SCRUB_HISTORY)
    return o.select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("pool"), F.when(F.col("o_orderstatus") == "P", "in_progress").otherwise("completed").alias("status"), F.col("k").cast("long").alias("k"))


# Integrity checks. Faults are injected by predicates that both engines share.

_E3 = "CASE WHEN extent_no % 307 = 0 THEN -length ELSE length END"
_ALG = "CASE WHEN extent_no % 311 = 0 THEN 'crc32' ELSE 'blake3' END"
_SUM = "CASE WHEN extent_no % 3 = 0 THEN '' ELSE 'x' END"


def _extents(p, x):
    return p.extents() if x is None else x


def _extent_rules(p, x=None):
    x = _extents(p, x).select("extent_no", F.expr(_E3).alias("length"), F.expr(_ALG).alias("checksum_alg"), F.expr(_SUM).alias("checksum"))
    return checks.checksum_algorithm(x).unionByName(checks.positive_length(x))


def _m1(p, x=None):
    return checks.dangling_files(_extents(p, x), p.files().where("file_id % 97 <> 0"))


def _m2(p, x=None):
    return checks.dangling_disks(_extents(p, x), p.disks().where("disk_id % 13 <> 0"))


def _m3(p, x=None):
    x = _extents(p, x).select("extent_no")
    return checks.duplicate_extents(x.unionByName(x.where("extent_no % 211 = 0")))


def _p1(p, x=None):
    x = _extents(p, x).select("extent_no", "pg")
    groups = x.select("pg").distinct().where("pg % 89 <> 0")
    members = x.unionByName(x.where("extent_no % 401 = 0").selectExpr("extent_no + 900 AS extent_no", "pg"))
    return checks.group_references(x, groups, members)


_SQL_RULES = f"""SELECT 'E2' AS code, 'extent' AS kind, CAST(extent_no AS VARCHAR) AS entity FROM ext WHERE {_SUM} <> '' AND {_ALG} <> 'blake3'
UNION ALL SELECT 'E3', 'extent', CAST(extent_no AS VARCHAR) FROM ext WHERE {_E3} <= 0"""
_SQL_M1 = "SELECT 'M1' AS code, 'extent' AS kind, CAST(extent_no AS VARCHAR) AS entity FROM ext WHERE NOT EXISTS (SELECT 1 FROM files WHERE files.file_id = ext.file_id AND files.file_id % 97 <> 0)"
_SQL_M2 = "SELECT 'M2' AS code, 'extent' AS kind, CAST(extent_no AS VARCHAR) AS entity FROM ext WHERE NOT EXISTS (SELECT 1 FROM disks WHERE disk_id = data_disk AND disk_id % 13 <> 0)"
_SQL_M3 = "SELECT 'M3' AS code, 'extent' AS kind, CAST(extent_no AS VARCHAR) AS entity FROM ext WHERE extent_no % 211 = 0"
_SQL_P1 = """SELECT 'P1' AS code, CAST(extent_no AS VARCHAR) AS entity, CAST(pg AS VARCHAR) AS ref FROM ext WHERE pg % 89 = 0
UNION ALL SELECT 'P1', CAST(pg AS VARCHAR), CAST(extent_no + 900 AS VARCHAR) FROM ext WHERE extent_no % 401 = 0 AND extent_no + 900 NOT IN (SELECT extent_no FROM ext)"""
_SQL_P4 = """SELECT 'P4' AS code, pg AS entity, first, extent_no AS dup FROM (
  SELECT *, first_value(extent_no) OVER w AS first, row_number() OVER w AS k FROM ext WINDOW w AS (PARTITION BY pg, data_disk ORDER BY extent_no)) WHERE k > 1"""

query("chk02_chk03_extent_rules", "ext", _SQL_RULES)(_extent_rules)
query("join01_m1_dangling_file", "ext files", _SQL_M1)(_m1)
query("join02_m2_dangling_disk", "ext disks", _SQL_M2)(_m2)
query("agg19_m3_duplicate_extent", "ext", _SQL_M3)(_m3)
query("join03_p1_group_refs", "ext", _SQL_P1)(_p1)


@query("chk07_p4_aliasing", "ext", _SQL_P4)
def _p4(p, x=None):
    return checks.aliased_members(_extents(p, x).select("extent_no", "pg", "data_disk"))


@query("set01_all_state_checks", "ext files disks", f"""SELECT CAST(o AS INTEGER) AS check_order, code, count(*) AS n FROM (
  SELECT 1 AS o, code FROM ({_SQL_RULES}) UNION ALL SELECT 2, code FROM ({_SQL_M1}) UNION ALL SELECT 3, code FROM ({_SQL_M2}) UNION ALL SELECT 4, code FROM ({_SQL_M3})
  UNION ALL SELECT 5, code FROM ({_SQL_P1}) UNION ALL SELECT 6, code FROM ({_SQL_P4})) GROUP BY o, code""")
def _(p):
    x = p.stored_extents()
    named = [(1, _extent_rules(p, x)), (2, _m1(p, x)), (3, _m2(p, x)), (4, _m3(p, x)), (5, _p1(p, x)), (6, _p4(p, x))]
    return checks.all_checks(named)


@query("join21_uuid_unique", "", "SELECT trim(s_name) AS uuid, count(*) AS n FROM (SELECT s_name FROM supplier UNION ALL SELECT s_name || ' ' FROM supplier WHERE s_suppkey % 17 = 0) GROUP BY 1 HAVING count(*) > 1")
def _(p):
    s = p.table("supplier")
    u = s.select("s_name").unionByName(s.where("s_suppkey % 17 = 0").select(F.concat("s_name", F.lit(" ")).alias("s_name")))
    return u.groupBy(F.trim("s_name").alias("uuid")).agg(F.count("*").alias("n")).where("n > 1")


@query("win09_generation", "", """SELECT o_orderkey AS seq, gen, prev FROM (
  SELECT *, lag(gen) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM (SELECT o_orderkey, o_custkey, CAST(floor(o_totalprice) AS BIGINT) AS gen FROM orders)) WHERE gen < prev""")
def _(p):
    o = p.table("orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("pool"), F.floor("o_totalprice").cast("long").alias("gen"))
    return checks.lower_generation(o)


# Journal

_STEPS = f"""steps AS (SELECT *, first_value(repair) OVER w AS is_repair, lag(state) OVER w AS before FROM journal WINDOW w AS (PARTITION BY tx ORDER BY seq)),
judged AS (SELECT *, before IS NULL OR CASE WHEN is_repair THEN before || '>' || state IN ({', '.join(repr(f'{a}>{b}') for a, b in C.REPAIR_TRANSITIONS)})
  ELSE before || '>' || state IN ({', '.join(repr(f'{a}>{b}') for a, b in C.TRANSITIONS)}) END AS legal FROM steps),
t AS (SELECT tx, arg_max(state, seq) AS last_state, arg_max(repair, seq) AS repair, bool_and(legal) AS legal, min(seq) AS first_seq FROM judged GROUP BY tx)
--
"""


@query("wal01_replay_summary", "journal", _STEPS + """SELECT * FROM (SELECT tx, last_state, CASE WHEN NOT legal THEN 'aborted' WHEN repair AND last_state NOT IN ('committed', 'aborted') THEN 'replay-required'
  WHEN last_state IN ('committed', 'aborted') THEN NULL WHEN last_state = 'prepared' THEN 'aborted' ELSE 'replay-required' END AS outcome, first_seq FROM t) WHERE outcome IS NOT NULL""")
def _(p):
    return wal.replay_summary(p.journal())


@query("wal01_last_closed", "journal", _STEPS + """SELECT arg_max(tx, first_seq) FILTER (last_state = 'committed') AS last_committed, arg_max(tx, first_seq) FILTER (last_state = 'aborted') AS last_aborted FROM t WHERE legal""")
def _(p):
    return wal.last_closed(p.journal())


@query("wal02_recovery_plan", "journal", """t AS (SELECT tx, arg_max(state, seq) AS last, arg_max(state, seq) FILTER (state <> 'replay-required') AS worked, arg_max(repair, seq) AS repair FROM journal GROUP BY tx),
e AS (SELECT tx, repair, CASE WHEN last = 'replay-required' THEN worked ELSE last END AS effective_state FROM t)
--
SELECT tx, effective_state, CASE WHEN repair THEN CASE WHEN effective_state IN ('committed', 'aborted') THEN 'skip' ELSE 'repair' END WHEN effective_state = 'committed' THEN 'reconcile'
  WHEN effective_state = 'aborted' THEN 'skip' WHEN effective_state = 'prepared' THEN 'abort' WHEN effective_state IN ('data-written', 'parity-written', 'metadata-written', 'replay-required') THEN 'roll-forward' ELSE 'unsupported' END AS action FROM e""")
def _(p):
    return wal.recovery_plan(p.journal())


@query("wal08_j2_transitions", "journal", _STEPS + "SELECT tx, arg_min(before, seq) AS from_state, arg_min(state, seq) AS to_state FROM judged WHERE NOT legal GROUP BY tx")
def _(p):
    return wal.illegal_transitions(p.journal())


@query("wal10_admission", "journal disks", """r AS (SELECT true AS hard FROM (SELECT tx, arg_max(state, seq) AS last FROM journal GROUP BY tx) WHERE last NOT IN ('committed', 'aborted')
  UNION ALL SELECT false FROM disks WHERE health = 'failed')
--
SELECT CASE WHEN h > 0 THEN 'refuse' WHEN s > 0 THEN 'degraded' ELSE 'ok' END AS status, CASE WHEN h > 0 THEN h ELSE s END AS n_reasons FROM (SELECT count(*) FILTER (hard) AS h, count(*) FILTER (NOT hard) AS s FROM r)""")
def _(p):
    last = p.journal().groupBy("tx").agg(F.max_by("state", "seq").alias("last")).where("last NOT IN ('committed', 'aborted')")
    return wal.admission(last.select(F.lit(True).alias("hard")).unionByName(p.disks().where("health = 'failed'").select(F.lit(False).alias("hard"))))


@query("snk04_compactable", "journal", "SELECT count(*) FILTER (last NOT IN ('committed', 'aborted')) = 0 AS compactable, count(*) FILTER (last NOT IN ('committed', 'aborted')) AS n_open FROM (SELECT arg_max(state, seq) AS last FROM journal GROUP BY tx)")
def _(p):
    return wal.compactable(p.journal())


# XOR protection. A blob is lost where extent_no % 157 = 0, cut where % 131 = 0, corrupt where % 101 = 0; parity lost where pg % 83 = 0.


@query("agg01_xor_parity", "ext lanes", "SELECT pg, lane, bit_xor(word) AS word FROM lanes GROUP BY pg, lane")
def _(p):
    return xor.xor_lanes(p.lanes())


@query("agg01_xor_parity_arrow", "ext lanes", "SELECT pg, string_agg(printf('%08x', word), '' ORDER BY lane) AS parity_hex FROM (SELECT pg, lane, bit_xor(word) AS word FROM lanes GROUP BY pg, lane) GROUP BY pg")
def _(p):
    x = p.extents().select("pg", F.expr("unhex(substr(sha2(cast(extent_no AS string), 256), 1, cast((length / 4096 % 8 + 1) * 8 AS int)))").alias("content"))
    return xor.xor_blobs(x, arrow=True).select("pg", F.lower(F.hex("parity")).alias("parity_hex"))


_HEX = "substr({h}(CAST(extent_no AS {s}){b}), 1, CAST((length {div} 4096 % 8 + 1) * 8 AS INT))"
_REASON = "CASE WHEN extent_no % 157 = 0 THEN 'missing' WHEN extent_no % 131 = 0 THEN 'length' WHEN extent_no % 101 = 0 THEN 'digest' END"


@query("chk01_extent_digest", "ext", f"SELECT CAST(extent_no AS VARCHAR) AS entity, {_REASON} AS reason FROM ext WHERE {_REASON} IS NOT NULL AND extent_no % 3 <> 0")
def _(p):
    content = F.expr(_HEX.format(h="sha2", s="STRING", b=", 256", div="DIV"))
    x = p.extents().select("extent_no", content.alias("hex"))
    catalog = x.select("extent_no", F.when(F.col("extent_no") % 3 == 0, "").otherwise(F.sha2("hex", 256)).alias("checksum"), F.length("hex").alias("stored_length"))
    no = F.col("extent_no")
    damaged = F.when(no % 131 == 0, F.concat("hex", F.lit("0"))).when(no % 101 == 0, F.concat(F.lit("z"), F.substring("hex", 2, 64))).otherwise(F.col("hex"))
    blobs = x.where(no % 157 != 0).select("extent_no", damaged.alias("content"))
    return checks.extent_content(catalog, blobs)


@query("chk06_parity_xor", "ext lanes", "SELECT DISTINCT 'P3' AS code, CAST(pg AS VARCHAR) AS entity FROM lanes WHERE pg % 71 = 0")
def _(p):
    lanes = p.lanes()
    stored = xor.xor_lanes(lanes).withColumn("word", F.when((F.col("pg") % 71 == 0) & (F.col("lane") == 0), F.col("word").bitwiseXOR(F.lit(1))).otherwise(F.col("word")))
    return xor.parity_mismatches(lanes, stored)


def _damage(p):
    """Presence of extents and groups after disks with id % 19 = 3 lost their files and groups of pg % 8300 = 0 their parity."""
    x = p.extents().select("extent_no", "pg", "data_disk", "length", (F.col("data_disk") % 19 != 3).alias("present"))
    g = x.select("pg").distinct().select("pg", (F.col("pg") % 10 * 10).alias("parity_disk"), (F.col("pg") % 8300 != 0).alias("present"))
    return x, g


_DAMAGE = """x AS (SELECT extent_no, pg, data_disk, length, data_disk % 19 <> 3 AS present FROM ext),
g AS (SELECT DISTINCT pg, pg % 10 * 10 AS parity_disk, pg % 8300 <> 0 AS present FROM ext),
f AS (SELECT data_disk AS d FROM x WHERE NOT present UNION SELECT parity_disk FROM g WHERE NOT present),
y AS (SELECT x.*, data_disk IN (FROM f) AS down FROM x),
l AS (SELECT pg, {lost} AS lost FROM g),
z AS (SELECT y.*, lost FROM y JOIN l USING (pg))
--
SELECT (SELECT count(*) FROM f) AS failed_disks, (SELECT count(*) FILTER (lost) FROM l) AS lost_groups, count(*) FILTER (down AND lost) AS lost_extents, count(*) FILTER (down AND NOT lost) AS rebuildable_extents,
  CAST(coalesce(sum(length) FILTER (down AND lost), 0) AS BIGINT) AS lost_bytes, CAST(coalesce(sum(length) FILTER (NOT present), 0) AS BIGINT) AS affected_bytes,
  CAST(coalesce(sum(length) FILTER (present), 0) AS BIGINT) AS present_bytes, count(*) FILTER (down AND lost) = 0 AS possible, CASE WHEN (SELECT count(*) FROM f) > 1 THEN 'dual' ELSE 'single' END AS mode FROM z"""


@query("rec01_multidisk_ref", "ext", _DAMAGE.format(lost="parity_disk IN (FROM f)"))
def _(p):
    return recovery.multi_disk(*_damage(p))


@query("rec01_multidisk_strict", "ext", _DAMAGE.format(lost="(SELECT count(*) FROM y WHERE y.pg = g.pg AND down) + CAST(parity_disk IN (FROM f) AS INT) >= 2"))
def _(p):
    return recovery.multi_disk(*_damage(p), strict=True)


@query("rec02_reconstruct", "ext lanes", "SELECT extent_no, lane, word AS value, true AS ok FROM lanes WHERE extent_no % 157 = 0")
def _(p):
    lanes = p.lanes(p.stored_extents())
    targets = lanes.where("extent_no % 157 = 0").groupBy("extent_no", "pg").agg(F.count("*").alias("n_lanes"))
    got = xor.reconstruct(lanes, xor.xor_lanes(lanes), targets)
    return got.join(lanes.select("extent_no", "lane", "word"), ["extent_no", "lane"]).select("extent_no", "lane", "value", (F.col("value") == F.col("word")).alias("ok"))


def _verdicts(p):
    """extent_no, data_disk, length, reason, parity_ok, peers_ok: whether parity and all other members are sound."""
    from pyspark.sql import Window as W

    x = p.extents().select("extent_no", "pg", "data_disk", "length", F.expr(_REASON).alias("reason"))
    bad = F.count("reason").over(W.partitionBy("pg"))
    return x.withColumn("parity_ok", F.col("pg") % 83 != 0).withColumn("peers_ok", bad - F.col("reason").isNotNull().cast("int") == 0)


_VERDICTS = f"v AS (SELECT *, {_REASON} AS reason, pg % 83 <> 0 AS parity_ok, count({_REASON}) OVER (PARTITION BY pg) - CAST({_REASON} IS NOT NULL AS INT) = 0 AS peers_ok FROM ext)\n--\n"


@query("rec04_scrub_report", "ext", _VERDICTS + "SELECT CASE WHEN reason IS NULL THEN 'clean' WHEN parity_ok AND peers_ok THEN 'healed' ELSE 'failed' END AS status, count(*) AS n, CAST(sum(length) AS BIGINT) AS bytes FROM v GROUP BY 1")
def _(p):
    return recovery.scrub(_verdicts(p))


_PLAN = _VERDICTS + """SELECT data_disk AS disk_id, count(*) FILTER (extent_no % 4 <> 0) AS scanned, count(*) FILTER (extent_no % 4 = 0) AS skipped,
  count(*) FILTER (extent_no % 4 <> 0 AND reason IS NOT NULL AND parity_ok AND peers_ok) AS rebuilt, count(*) FILTER (extent_no % 4 <> 0 AND reason IS NOT NULL AND NOT (parity_ok AND peers_ok)) AS failed FROM v GROUP BY 1"""


def _plan(p):
    return recovery.rebuild_plan(_verdicts(p), p.extents().where("extent_no % 4 = 0").select("extent_no"))


query("rec05_rebuild_plan", "ext", _PLAN)(_plan)


@query("rec06_rebuild_all", "ext", _PLAN.replace("\n--\nSELECT", ",\np AS (SELECT", 1) + ")\n--\nSELECT count(*) AS disks, CAST(sum(scanned) AS BIGINT) AS scanned, CAST(sum(skipped) AS BIGINT) AS skipped, CAST(sum(rebuilt) AS BIGINT) AS rebuilt, CAST(sum(failed) AS BIGINT) AS failed, bool_and(failed = 0) AS healthy FROM p")
def _(p):
    return recovery.rebuild_all(_plan(p))


# Placement


@query("plc01_split_and_group", "files", """s AS (SELECT file_id, 4096 * (file_id % 40) + file_id % 7 AS size FROM files)
--
SELECT file_id, i AS n, (i - 1) * 16384 AS "offset", least(16384, size - (i - 1) * 16384) AS length, (i - 1) // 3 + 1 AS pg_no FROM s, unnest(range(1, (size + 16383) // 16384 + 1)) AS u(i)""")
def _(p):
    return placement.split_files(p.files().select("file_id", (F.col("file_id") % 40 * 4096 + F.col("file_id") % 7).alias("size")), 16384, 3)


@query("plc01_greedy_placement")
def _(p):
    return placement.greedy_placement(p.extents(), p.disks())


@query("plc02_append_allocation", "files", """s AS (SELECT file_id, file_id % 1000 AS existing, 4096 * (file_id % 11) AS append FROM files)
--
SELECT file_id, existing + k AS number, (existing + k) % 7 AS disk_idx, (existing + k - 1) // 3 + 1 AS pg_no,
  printf('data/%02x/%02x/extent-%06d.bin', (existing + k) // 256 % 256, (existing + k) % 256, existing + k) AS path FROM s, unnest(range(1, (append + 16383) // 16384 + 1)) AS u(k)""")
def _(p):
    return placement.append_extents(p.files().select("file_id", (F.col("file_id") % 1000).alias("existing"), (F.col("file_id") % 11 * 4096).alias("append")), 16384, 7)


@query("plc03_relocate", "ext disks", """RECURSIVE m AS (SELECT extent_no, length, row_number() OVER (ORDER BY extent_no) AS i FROM ext WHERE data_disk = 5),
load AS (SELECT data_disk, count(*) AS n FROM ext GROUP BY data_disk),
d AS (SELECT list(disk_id ORDER BY disk_id) AS ids, list(free ORDER BY disk_id) AS frees, list(coalesce(n, 0) ORDER BY disk_id) AS loads FROM disks LEFT JOIN load ON data_disk = disk_id WHERE role = 'data' AND health = 'online' AND disk_id <> 5),
f AS (SELECT CAST(0 AS BIGINT) AS i, loads, CAST(NULL AS BIGINT) AS extent_no, CAST(NULL AS BIGINT) AS pick FROM d
  UNION ALL SELECT i, list_transform(loads, lambda l, k: l + CAST(k = pick AS BIGINT)), extent_no, pick FROM (
    SELECT m.i, f.loads, m.extent_no, list_sort(list_filter(list_transform(range(1, len(ids) + 1), lambda k: {'a': f.loads[k], 'b': -frees[k], 'k': k}), lambda t: -t.b >= m.length))[1].k AS pick FROM f JOIN m ON m.i = f.i + 1, d))
--
SELECT extent_no, ids[pick] AS new_disk FROM f, d WHERE i > 0""")
def _(p):
    return placement.relocate(p.extents(), p.disks(), 5)


# Catalog changes, reads, namespace


@query("fil03_file_extents", "ext files", "SELECT path, extent_no, logical_offset, length FROM ext JOIN files USING (file_id) WHERE path = (SELECT min(path) FROM files)")
def _(p):
    # The path is the result of an aggregate: one row, which is joined and not fetched.
    return mutations.extents_of(p.files().join(F.broadcast(p.files().agg(F.min("path").alias("path"))), "path"), p.extents())


@query("fil04_range_overlap", "ext", "SELECT file_id, extent_no, greatest(logical_offset, 100000) AS overlap_start, least(logical_offset + length, 300000) - greatest(logical_offset, 100000) AS overlap_len FROM ext WHERE logical_offset < 300000 AND logical_offset + length > 100000")
def _(p):
    return mutations.overlapping(p.extents(), F.lit(100000), F.lit(300000))


@query("mut03_truncate", "ext disks", "SELECT disk_id, count(extent_no) AS removed, CAST(coalesce(sum(length), 0) AS BIGINT) AS freed, CAST(free + coalesce(sum(length), 0) AS BIGINT) AS free FROM disks LEFT JOIN ext ON data_disk = disk_id AND logical_offset + length > 250000 GROUP BY disk_id, free")
def _(p):
    return mutations.release(p.disks(), mutations.truncated(p.extents(), F.lit(250000)))


@query("mut05_delete", "ext disks", "SELECT disk_id, count(extent_no) AS removed, CAST(coalesce(sum(length), 0) AS BIGINT) AS freed, CAST(free + coalesce(sum(length), 0) AS BIGINT) AS free FROM disks LEFT JOIN ext ON data_disk = disk_id AND file_id % 10 = 3 GROUP BY disk_id, free")
def _(p):
    gone = p.files().where("file_id % 10 = 3").select("file_id")
    return mutations.release(p.disks(), p.extents().join(gone, "file_id", "left_semi"))


@query("mut06_rename", "files", "SELECT file_id, CASE WHEN starts_with(path, '/shares/f/') THEN '/archive' || substr(path, 10) ELSE path END AS path FROM files")
def _(p):
    return mutations.renamed(p.files().select("file_id", "path"), "/shares/f", "/archive")


@query("join12_upsert_files", "files", """n AS (SELECT CASE WHEN file_id % 6 = 0 THEN file_id ELSE -file_id END AS file_id, '/new' || path AS path FROM files WHERE file_id % 3 = 0)
--
SELECT coalesce(n.file_id, f.file_id) AS file_id, coalesce(n.path, f.path) AS path, CASE WHEN f.file_id IS NULL THEN 'inserted' WHEN n.file_id IS NULL THEN 'kept' ELSE 'updated' END AS source FROM files AS f FULL JOIN n ON f.file_id = n.file_id""")
def _(p):
    f = p.files().select("file_id", "path")
    new = f.where("file_id % 3 = 0").select(F.expr("CASE WHEN file_id % 6 = 0 THEN file_id ELSE -file_id END").alias("file_id"), F.concat(F.lit("/new"), "path").alias("path"))
    return mutations.upsert(f, new, "file_id")


@query("join13_merge_members", "ext", """o AS (SELECT pg, list(extent_no ORDER BY extent_no) AS m FROM ext WHERE extent_no % 3 <> 0 GROUP BY pg), n AS (SELECT pg, list(extent_no ORDER BY extent_no) AS m FROM ext WHERE extent_no % 2 = 0 GROUP BY pg)
--
SELECT pg, array_to_string(list_concat(coalesce(o.m, []), list_filter(coalesce(n.m, []), lambda x: NOT list_contains(coalesce(o.m, []), x))), ',') AS members FROM o FULL JOIN n USING (pg)""")
def _(p):
    x = p.extents().select("pg", "extent_no")
    lists = lambda df: df.groupBy("pg").agg(F.sort_array(F.collect_list("extent_no")).alias("members"))
    return mutations.merge_members(lists(x.where("extent_no % 3 <> 0")), lists(x.where("extent_no % 2 = 0"))).select("pg", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query("join15_membership_diff", "ext", "SELECT pg, bool_or(extent_no % 50 = 0) AS changed FROM ext GROUP BY pg")
def _(p):
    x = p.extents().select("pg", "extent_no")
    lists = lambda df: df.groupBy("pg").agg(F.collect_list("extent_no").alias("members"))
    return mutations.changed_members(lists(x), lists(x.where("extent_no % 50 <> 0")))


@query("agg22_assemble", "ext", f"""c AS (SELECT file_id, logical_offset, {_HEX.format(h='sha256', s='VARCHAR', b='', div='//')} AS content FROM ext), a AS (SELECT file_id, string_agg(content, '' ORDER BY logical_offset) AS content FROM c GROUP BY file_id)
--
SELECT file_id, length(content) AS size, sha256(content) AS digest FROM a""")
def _(p):
    return mutations.assembled(p.extents().select("file_id", "logical_offset", F.expr(_HEX.format(h="sha2", s="STRING", b=", 256", div="DIV")).alias("content")))


@query("ns01_readdir", "files", "SELECT split_part(substr(path, 9), '/', 1) AS name, contains(substr(path, 9), '/') AS is_dir FROM files GROUP BY ALL")
def _(p):
    return namespace.listing(p.files(), "/shares")


@query("ns02_lookup", "files", "SELECT CASE WHEN bool_or(path = '/shares/f') THEN 'file' ELSE 'directory' END AS kind FROM files WHERE path = '/shares/f' OR starts_with(path, '/shares/f/')")
def _(p):
    return namespace.lookup(p.files(), "/shares/f")


@query("pool02_validate", "disks", "SELECT CASE WHEN d > 0 THEN 'invalid' WHEN m > 0 THEN 'degraded' ELSE 'healthy' END AS status, m AS missing, d AS duplicates FROM (SELECT count(*) FILTER (disk_id % 23 = 0) AS m, count(*) FILTER (disk_id % 29 = 1 AND disk_id % 23 <> 0) AS d FROM disks)")
def _(p):
    d = p.disks().select("disk_id")
    found = d.where("disk_id % 23 <> 0")
    return namespace.validate_pool(d, found.unionByName(found.where("disk_id % 29 = 1")))


# Functions


@query("fil18_smart_rules", "", """SELECT s_suppkey AS disk_id, CASE WHEN s_suppkey % 150 > 100 THEN 'reallocated' WHEN s_suppkey * 3 % 70 > 50 THEN 'pending' WHEN s_suppkey % 31 = 0 THEN 'uncorrectable' WHEN 30 + s_suppkey % 40 > 60 THEN 'celsius'
  WHEN s_suppkey * 7001 > 1000000 THEN 'error_rate' END AS violation FROM supplier""")
def _(p):
    s = p.table("supplier")
    at = lambda i, e: F.concat(F.lit(f'"id":{i},"name":"attribute_{i}","value":'), F.expr(e).cast("string"))
    report = F.concat_ws(",", at(5, "s_suppkey % 150"), at(197, "s_suppkey * 3 % 70"), at(198, "int(s_suppkey % 31 = 0)"), at(194, "30 + s_suppkey % 40"), at(200, "s_suppkey * 7001"))
    return s.select(F.col("s_suppkey").alias("disk_id"), C.smart_violation({n: C.smart_attribute(report, i) for i, n in C.SMART_IDS}).alias("violation"))


@query("fn11_file_type", "", """SELECT o_orderkey AS file_id, CASE (o_orderkey * 4096) & 61440 WHEN 40960 THEN 'symlink' WHEN 16384 THEN 'directory' WHEN 4096 THEN 'fifo' WHEN 49152 THEN 'socket' WHEN 24576 THEN 'block' WHEN 8192 THEN 'char' ELSE 'regular' END AS file_type FROM orders""")
def _(p):
    return p.table("orders").select(F.col("o_orderkey").alias("file_id"), C.file_type(F.col("o_orderkey") * 4096).alias("file_type"))


@query("fn14_sanitize_disk", "", "SELECT s_suppkey AS disk_id, regexp_replace(s_name, '[^A-Za-z0-9_-]', '_', 'g') AS safe FROM supplier")
def _(p):
    return p.table("supplier").select(F.col("s_suppkey").alias("disk_id"), C.sanitized_disk(F.col("s_name")).alias("safe"))


@query("fn15_extent_path", "ext files", "SELECT extent_no, 'data/' || substr(sha256(path), 1, 2) || '/' || substr(sha256(path), 3, 2) || printf('/extent-%06d.bin', extent_no) AS path FROM ext JOIN files USING (file_id)")
def _(p):
    x = p.extents().select("extent_no", "file_id").join(p.files().select("file_id", "path"), "file_id")
    return x.select("extent_no", C.extent_path(F.col("path"), F.col("extent_no")).alias("path"))


# State machines


@query("str01_idempotent_dedupe", "", "SELECT event_type || user_id AS k, arg_min(event_id, {'a': ts, 'b': event_id}) AS first_event FROM events GROUP BY 1")
def _(p):
    return state.first_requests(p.table("events").select("event_id", "ts", F.concat("event_type", F.col("user_id").cast("string")).alias("k")), "k", ["ts", "event_id"])


@query("str03_breaker", "", """RECURSIVE r AS (SELECT user_id AS disk, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS sec, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('second', ts), event_id) AS i FROM events),
f AS (SELECT DISTINCT disk, CAST(0 AS BIGINT) AS i, 'closed' AS state, CAST(0 AS BIGINT) AS failures, CAST(0 AS BIGINT) AS last, CAST(0 AS BIGINT) AS rejected FROM r
  UNION ALL SELECT r.disk, r.i, CASE WHEN state = 'open' AND sec - last <= 60 THEN 'open' WHEN NOT failed THEN 'closed' WHEN failures + 1 >= 3 THEN 'open' WHEN state = 'open' THEN 'half-open' ELSE state END,
    CASE WHEN state = 'open' AND sec - last <= 60 THEN failures WHEN failed THEN failures + 1 ELSE 0 END, CASE WHEN (state <> 'open' OR sec - last > 60) AND failed THEN sec ELSE last END, rejected + CAST(state = 'open' AND sec - last <= 60 AS BIGINT)
  FROM f JOIN r ON r.disk = f.disk AND r.i = f.i + 1)
--
SELECT disk, arg_max(state, i) AS final_state, arg_max(failures, i) AS failures, arg_max(rejected, i) AS rejected FROM f GROUP BY disk""")
def _(p):
    second = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return state.final_breaker(p.samples().select("disk", second.alias("second"), "event_id", (F.col("event_type") == "error").alias("failed")))


@query("str04_health_fsm", "", """RECURSIVE r AS (SELECT user_id AS disk, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT DISTINCT disk, CAST(0 AS BIGINT) AS i, 'ok' AS status, CAST(0 AS BIGINT) AS failures FROM r
  UNION ALL SELECT r.disk, r.i, CASE WHEN failed THEN CASE WHEN failures + 1 >= 3 THEN 'failing' ELSE 'suspect' END WHEN failures - CAST(failures > 0 AND status = 'suspect' AS BIGINT) = 0 THEN 'ok' ELSE status END,
    CASE WHEN failed THEN failures + 1 ELSE failures - CAST(failures > 0 AND status = 'suspect' AS BIGINT) END
  FROM f JOIN r ON r.disk = f.disk AND r.i = f.i + 1)
--
SELECT disk, arg_max(status, i) AS final_state, arg_max(failures, i) AS failures FROM f GROUP BY disk""")
def _(p):
    return state.final_health(p.samples().select("disk", "ts", "event_id", (F.col("event_type") == "error").alias("failed")))


@query("str05_alert_edges", "", "SELECT user_id AS pool, ts, event_id, event_type AS kind FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE event_type IS DISTINCT FROM b")
def _(p):
    return state.alert_edges(p.table("events").select(F.col("user_id").alias("pool"), "ts", "event_id", F.col("event_type").alias("kind")))
