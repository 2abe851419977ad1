"""Requests to the pool: validation, batches, error envelopes, logs, exposition and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the command interface.
ERROR_CODES = {"invalid params": 1001, "not found": 1002, "internal": 1003, "rate limited": 1004, "timeout": 1005, "not implemented": 1006, "permission": 1007, "invalid state": 1008}
LEVELS = ("debug", "info", "warn", "error")
CODECS = ("zstd", "lz4", "snappy", "gzip", "xz")
MAX_BATCH = 100


def write_error(path: Column, size: Column, has_payload: Column, synthetic: Column, codec: Column) -> Column:
    """The first thing wrong with a write request; null if nothing is. A payload's own length replaces the size that was given."""
    return (
        F.when(path == "", "path required").when((size < 0) & ~has_payload, "negative size").when(~has_payload & ~synthetic, "payload required")
        .when((codec != "") & ~codec.isin(*CODECS), "unsupported codec")
    )


def valid_pool_name(name: Column) -> Column:
    return name.rlike(r"\A[a-z0-9_ -]{1,64}\z")


def path_error(path: Column) -> Column:
    """Why a relative blob path is refused: absolute, not canonical, or leading upwards."""
    odd = path.rlike(r"//|(^|/)\.(/|$)|/$|[^/]/\.\.(/|$)") | (path == "")
    return F.when(path.startswith("/"), "absolute").when(odd, "not canonical").when(path.rlike(r"(^|/)\.\.(/|$)"), "traversal")


def error_code(kind: Column) -> Column:
    """Code of an error's kind; an error of no known kind is internal, no error is 0."""
    out = F.when(kind.isNull(), 0)
    for name, code in ERROR_CODES.items():
        out = out.when(kind == name, code)
    return out.otherwise(ERROR_CODES["internal"])


def batch(commands: DataFrame, slow_ms: int = 5000) -> DataFrame:
    """batch_id, seq, error_code, slow of the commands of batches; a batch that is empty or above the limit gives one error row."""
    size = F.size("commands")
    refused = commands.where((size == 0) | (size > MAX_BATCH)).select("batch_id", F.lit(-1).alias("seq"), F.lit(ERROR_CODES["internal"]).alias("error_code"), F.lit(False).alias("slow"))
    run = commands.where((size > 0) & (size <= MAX_BATCH)).select("batch_id", F.posexplode("commands").alias("seq", "c"))
    return run.select("batch_id", "seq", error_code(F.col("c.error")).alias("error_code"), (F.col("c.latency_ms") > slow_ms).alias("slow")).unionByName(refused)


def logged(lines: DataFrame, least: str) -> DataFrame:
    """Lines at or above a level; unknown levels are never logged."""
    rank = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("level"))
    return lines.where((rank > 0) & (rank >= LEVELS.index(least) + 1))


def exposition(metrics: DataFrame, prefix: str) -> DataFrame:
    """One row: metrics (name, help, kind, value) as text exposition, ordered by name. Names are a fixed, small set."""
    line = F.concat(F.lit(f"# HELP {prefix}_"), "name", F.lit(" "), "help", F.lit(f"\n# TYPE {prefix}_"), "name", F.lit(" "), "kind", F.lit(f"\n{prefix}_"), "name", F.lit(" "), F.col("value").cast("string"))
    lines = F.array_sort(F.collect_list(F.struct("name", line.alias("line"))))
    return metrics.agg(F.array_join(lines.getField("line"), "\n").alias("text"))


def health_report(disks: DataFrame) -> DataFrame:
    """One row, report: a title and a block of text for each disk (disk_id, status, failures, checked, error, smart), in order of id;
    a line for an error and three for SMART data only where there are any. Disks are a dimension of bounded size."""
    line = lambda name, value: F.concat(F.lit(f"  {name}: "), value.cast("string"), F.lit("\n"))
    smart = F.concat(line("Temperature", F.concat(F.col("smart.celsius").cast("string"), F.lit("°C"))), line("Reallocated Sectors", F.col("smart.reallocated")), line("Power On Hours", F.col("smart.hours")))
    block = F.concat(
        F.lit("Disk: "), F.col("disk_id").cast("string"), F.lit("\n"), line("Status", F.col("status")), line("Failures", F.col("failures")),
        line("Last Check", F.date_format("checked", "yyyy-MM-dd'T'HH:mm:ss'Z'")), F.when(F.col("error") != "", line("Last Error", F.col("error"))).otherwise(""),
        F.when(F.col("smart").isNotNull(), smart).otherwise(""), F.lit("\n"),
    )
    blocks = F.array_sort(F.collect_list(F.struct("disk_id", block.alias("block"))))
    return disks.agg(F.concat(F.lit("=== Pool Health Report ===\n\n"), F.array_join(blocks.getField("block"), "")).alias("report"))


def record_kind(path: Column, has_file: Column, extents: Column) -> Column:
    """What a journal record is for, by its path: repair of an extent or of parity, scrub, rebuild; else ''."""
    repair, meta = ~has_file & (extents > 0), ~has_file & (extents == 0)
    return (
        F.when(repair & path.startswith("repair://extent/"), "extent").when(repair & path.startswith("repair://parity/"), "parity")
        .when(meta & path.startswith("metadata://scrub/"), "scrub").when(meta & path.startswith("metadata://rebuild/"), "rebuild").otherwise("")
    )


def encoding_violations(df: DataFrame, key: str, texts: list[str], limit: int = 65535) -> DataFrame:
    """key, field of texts that a 16-bit length can't hold."""
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.octet_length(c).alias("size")) for c in texts])
    return df.select(key, F.explode(fields).alias("f")).where(F.col("f.size") > limit).select(key, "f.field")


def catalog_json(disks: DataFrame) -> DataFrame:
    """disk_id, json: rows of a catalog as JSON objects."""
    return disks.select("disk_id", F.to_json(F.struct("disk_id", "role", "health")).alias("json"))


# The operations of the command interface by category.
OPERATIONS = {
    "info": ("ping", "version", "health", "host-info", "system-stats", "operations"),
    "metrics": ("metrics", "prometheus", "disk-stats", "pool-stats", "memory-pool-stats", "locks", "config-get"),
    "maintenance": ("check-consistency", "repair-metadata", "compact-journal", "export-journal", "validate-config"),
    "recovery": ("migrate-disk", "recovery-status", "scrub", "scrub-history", "rebuild", "rebuild-all"),
    "data": ("backup", "restore", "export-metadata", "import-metadata"),
    "io": ("write", "read", "bulk-write", "bulk-read", "reload-config"),
}


def operations(spark) -> DataFrame:
    """category, n of the operations, and their total."""
    rows = [(c, o) for c, names in OPERATIONS.items() for o in names]
    return spark.createDataFrame(rows, "category string, operation string").rollup("category").agg(F.count("*").cast("int").alias("n")).select(F.coalesce("category", F.lit("total")).alias("category"), "n")


def commands(lines: DataFrame) -> DataFrame:
    """event_id, op, disk, error_code of command lines (JSON with op and params); a line that is no such object has the code of
    invalid params."""
    c = lines.select("event_id", F.from_json("line", "op string, params struct<disk: bigint>").alias("c"))
    bad = F.col("c.op").isNull()
    return c.select("event_id", F.when(~bad, F.col("c.op")).alias("op"), F.when(~bad, F.col("c.params.disk")).alias("disk"), F.when(bad, ERROR_CODES["invalid params"]).otherwise(0).alias("error_code"))
