"""State machines over keyed event sequences: disk health, circuit breaker, idempotency, alert edges.

The transition functions are plain Python; the batch form folds a key's events in order in bounded pieces that a key's
task streams through, the streaming form keeps the same state with ``transformWithStateInPandas``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

FAILING_AT = 3


def health_step(status: str, failures: int, failed: bool) -> tuple[str, int]:
    """One check of a disk: a failure counts up (failing at three), a success counts down only while suspect."""
    if status in ("excluded", "failed"):
        return status, failures
    if failed:
        failures += 1
        return ("failing" if failures >= FAILING_AT else "suspect"), failures
    if failures > 0 and status == "suspect":
        failures -= 1
    return ("ok" if failures == 0 else status), failures


def breaker_step(state: str, failures: int, last: int, at: int, failed: bool, threshold: int = 3, timeout: int = 60) -> tuple[str, int, int, bool]:
    """One call through a breaker: (state, failures, time of last failure, whether it was let through)."""
    if state == "open":
        if at - last <= timeout:
            return state, failures, last, False
        state = "half-open"
    if failed:
        failures, last = failures + 1, at
        return ("open" if failures >= threshold else state), failures, last, True
    return "closed", 0, last, True


def _fold(rows: DataFrame, key: str, order: list[str], start, step, schema: str, finish) -> DataFrame:
    """Keys are hashed to partitions and sorted inside them; each partition is streamed, holding one key's state at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        now, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if state is None or row[key] != now:
                    if state is not None:
                        out.append(finish(now, state))
                    now, state = row[key], start
                state = step(state, row)
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out])
        if state is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, finish(now, state)))])

    # By a hash: an exchange by the plain key may be dropped for one below that adaptive execution takes away later.
    return rows.repartition(F.xxhash64(key)).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def final_health(checks: DataFrame) -> DataFrame:
    """disk, final_state, failures after all checks (disk, ts, event_id, failed) in order."""
    return _fold(checks.select("disk", "ts", "event_id", "failed"), "disk", ["ts", "event_id"], ("ok", 0), lambda s, r: health_step(*s, r["failed"]), "disk long, final_state string, failures long", lambda k, s: (k, *s))


def final_breaker(calls: DataFrame) -> DataFrame:
    """disk, final_state, failures, rejected after all calls (disk, second, event_id, failed) in order."""

    def step(s, r):
        state, failures, last, rejected = s
        state, failures, last, through = breaker_step(state, failures, last, r["second"], r["failed"])
        return state, failures, last, rejected + (not through)

    return _fold(calls.select("disk", "second", "event_id", "failed"), "disk", ["second", "event_id"], ("closed", 0, 0, 0), step, "disk long, final_state string, failures long, rejected long", lambda k, s: (k, s[0], s[1], s[3]))


def first_requests(requests: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, first_event of the requests that an idempotency cache lets through; an empty key bypasses it."""
    keyed = requests.where(F.col(key) != "").groupBy(key).agg(F.min_by("event_id", F.struct(*order)).alias("first_event"))
    return keyed.unionByName(requests.where(F.col(key) == "").select(key, F.col("event_id").alias("first_event")))


def alert_edges(ticks: DataFrame) -> DataFrame:
    """Ticks (pool, ts, event_id, kind) whose kind differs from that of the tick before in the same pool."""
    w = W.partitionBy("pool").orderBy("ts", "event_id")
    return ticks.withColumn("before", F.lag("kind").over(w)).where(~F.col("kind").eqNullSafe(F.col("before"))).select("pool", "ts", "event_id", "kind")


class HealthProcessor(StatefulProcessor):
    """Keyed by disk: input (disk, seq, failed), output (disk, status, failures) after every batch of a key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = StructType([StructField("status", StringType()), StructField("failures", IntegerType())])
        self.state = handle.getValueState("health", schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, failures = self.state.get() if self.state.exists() else ("ok", 0)
        for failed in pd.concat(list(rows)).sort_values("seq")["failed"]:
            status, failures = health_step(status, int(failures), bool(failed))
        self.state.update((status, failures))
        yield pd.DataFrame({"disk": [key[0]], "status": [status], "failures": [failures]})

    def close(self) -> None:
        pass


def stream_health(checks: DataFrame) -> DataFrame:
    """Streaming form of ``final_health``: an update per disk and batch. Needs the RocksDB state store provider."""
    return checks.groupBy("disk").transformWithStateInPandas(HealthProcessor(), "disk long, status string, failures int", "update", "none")


def stream_first_requests(requests: DataFrame, key: str = "idempotency_key", ts: str = "ts", ttl: str = "10 minutes") -> DataFrame:
    """Streaming form of ``first_requests`` with a time to live; keys are dropped from state after it."""
    return requests.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])
