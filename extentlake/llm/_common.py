"""Shared helpers: the shared scratch folder and table reading."""

from __future__ import annotations

import contextlib
import sys
import tempfile
import types
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Whole documents per Arrow batch.
BATCH_ROWS = 2000


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    """``key`` has ``value`` meanwhile."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def process_cache() -> dict:
    """What a Python worker keeps from task to task. It isn't a global of this package: those travel with every task."""
    return sys.modules.setdefault("_extentlake_cache", types.ModuleType("_extentlake_cache")).__dict__


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``. A local session may do without that setting, as in tests; on a
    cluster a machine's own folder would lose data without a word, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        base = getattr(spark, "_extentlake_scratch", None)
        if base is None:
            base = spark._extentlake_scratch = tempfile.mkdtemp(prefix="extentlake-")
    return base.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage, so that a lost executor costs a re-read and not a re-run."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
        """Write ``df`` and read it back; shuffle files of the write are removed once it is committed.

        ``batch_rows``: rows per Arrow batch while it is written; fewer for rows that hold large binaries.
        """
        schema = df.schema
        with _setting(self.spark, _CLEANUP, "true"), _setting(self.spark, _BATCH, str(batch_rows)):
            df.write.parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads; tables that were never written are passed over."""
        jvm = self.spark._jvm
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
