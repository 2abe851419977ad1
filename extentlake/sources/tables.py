"""Tables in the shared folder: backup and restore with a manifest, catalogs that are made when absent, logs that grow."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DISK = "disk_id string, uuid string, role string, filesystem_type string, mountpoint string, capacity_bytes bigint, free_bytes bigint, health_status string, generation bigint"
# The disks of a new pool.
PROTOTYPE_DISKS = (
    ("disk-01", "11111111-1111-1111-1111-111111111111", "data", "xfs", "/mnt/data01", 4 << 40, 3 << 40, "online", 1),
    ("disk-02", "22222222-2222-2222-2222-222222222222", "data", "xfs", "/mnt/data02", 8 << 40, 7 << 40, "online", 1),
    ("disk-parity", "33333333-3333-3333-3333-333333333333", "parity", "xfs", "/mnt/parity", 8 << 40, 7 << 40, "online", 1),
    ("disk-meta", "44444444-4444-4444-4444-444444444444", "metadata", "ext4", "/var/lib/extentlake", 64 << 30, 48 << 30, "online", 1),
)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``, which all executors see. Only a local session may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        base = tempfile.mkdtemp(prefix="extentlake-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def prototype_disks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROTOTYPE_DISKS, _DISK)


def load_or_create(spark: SparkSession, path: str, default: DataFrame) -> DataFrame:
    """The table at ``path``; where there is none, ``default`` is written there first. Spark's commit publishes it whole."""
    if not exists(spark, path):
        default.write.parquet(path)
    return spark.read.parquet(path)


def backup(tables: dict[str, DataFrame], path: str, version: str) -> DataFrame:
    """Write the tables and a manifest with the number of rows of each, counted in what was written; returns the manifest."""
    spark = next(iter(tables.values())).sparkSession
    counts = None
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
        n = spark.read.parquet(f"{path}/{name}").agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.lit(version).alias("version"))
        counts = n if counts is None else counts.unionByName(n)
    counts.coalesce(1).write.json(f"{path}/manifest")
    return spark.read.schema("name string, rows bigint, version string").json(f"{path}/manifest")


def restore(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a backup; one whose rows aren't as many as its manifest says is an error."""
    out = {}
    for name, rows, _ in spark.read.schema("name string, rows bigint, version string").json(f"{path}/manifest").collect():
        out[name] = spark.read.parquet(f"{path}/{name}")
        if (found := out[name].count()) != rows:
            raise ValueError(f"table {name} has {found} rows, its manifest says {rows}")
    return out


def log_events(events: DataFrame, path: str) -> None:
    """Append audit events (timestamp, operation, user, result, details) as lines of JSON."""
    events.select("timestamp", "operation", "user", "result", "details").write.mode("append").json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("timestamp string, operation string, user string, result string, details string").json(path)
