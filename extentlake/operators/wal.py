"""Write-ahead journal: replay summary, recovery plan, transition checks, compaction, admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import REPAIR_TRANSITIONS, STATES, TRANSITIONS, is_transition

OPEN_STATES = ("data-written", "parity-written", "metadata-written", "replay-required")


def steps(journal: DataFrame) -> DataFrame:
    """Records with their predecessor in the transaction and whether the step is legal; a repair transaction (its first
    record decides) has rules of its own. Transactions have a handful of records, so the window is bounded."""
    w = W.partitionBy("tx").orderBy("seq")
    j = journal.withColumn("before", F.lag("state").over(w)).withColumn("is_repair", F.first("repair").over(w))
    b, s = F.col("before"), F.col("state")
    legal = F.when(b.isNull(), True).when(F.col("is_repair"), is_transition(b, s, REPAIR_TRANSITIONS)).otherwise(is_transition(b, s, TRANSITIONS))
    return j.withColumn("legal", legal)


def illegal_transitions(journal: DataFrame) -> DataFrame:
    """J2: the first illegal step of each transaction."""
    first = steps(journal).where(~F.col("legal")).groupBy("tx").agg(F.min_by(F.struct("before", "state"), "seq").alias("s"))
    return first.select("tx", F.col("s.before").alias("from_state"), F.col("s.state").alias("to_state"))


def replay_outcome(last: Column, legal: Column, repair: Column) -> Column:
    """What replay makes of a transaction; null where nothing is left to do."""
    return (
        F.when(~legal, "aborted").when(repair & ~last.isin("committed", "aborted"), "replay-required")
        .when(last.isin("committed", "aborted"), F.lit(None)).when(last == "prepared", "aborted").otherwise("replay-required")
    )


def replay_summary(journal: DataFrame) -> DataFrame:
    """tx, last_state, outcome, first_seq of every transaction that replay has to act on."""
    t = steps(journal).groupBy("tx").agg(F.max_by("state", "seq").alias("last_state"), F.max_by("repair", "seq").alias("repair"), F.bool_and("legal").alias("legal"), F.min("seq").alias("first_seq"))
    t = t.withColumn("outcome", replay_outcome(F.col("last_state"), F.col("legal"), F.col("repair")))
    return t.where("outcome IS NOT NULL").select("tx", "last_state", "outcome", "first_seq")


def last_closed(journal: DataFrame) -> DataFrame:
    """Last committed and last aborted transaction, in the order in which transactions first appear."""
    t = steps(journal).groupBy("tx").agg(F.max_by("state", "seq").alias("last_state"), F.bool_and("legal").alias("legal"), F.min("seq").alias("first_seq")).where("legal")
    return t.agg(*[F.max_by(F.when(F.col("last_state") == s, F.col("tx")), F.when(F.col("last_state") == s, F.col("first_seq"))).alias(f"last_{s}") for s in ("committed", "aborted")])


def recovery_plan(journal: DataFrame) -> DataFrame:
    """tx, effective_state, action: the last record, or the last before replay was asked for; sequences aren't judged here."""
    worked = F.when(F.col("state") != "replay-required", F.col("seq"))
    t = journal.groupBy("tx").agg(F.max_by("state", "seq").alias("last"), F.max_by("state", worked).alias("worked"), F.max_by("repair", "seq").alias("repair"))
    t = t.withColumn("effective_state", F.when(F.col("last") == "replay-required", F.col("worked")).otherwise(F.col("last")))
    e = F.col("effective_state")
    action = (
        F.when(F.col("repair"), F.when(e.isin("committed", "aborted"), "skip").otherwise("repair"))
        .when(e == "committed", "reconcile").when(e == "aborted", "skip").when(e == "prepared", "abort").when(e.isin(*OPEN_STATES), "roll-forward").otherwise("unsupported")
    )
    return t.select("tx", "effective_state", action.alias("action"))


def compactable(journal: DataFrame) -> DataFrame:
    """The journal may be cut only when every transaction is closed."""
    last = journal.groupBy("tx").agg(F.max_by("state", "seq").alias("last"))
    n = F.count_if(~F.col("last").isin("committed", "aborted"))
    return last.agg((n == 0).alias("compactable"), n.alias("n_open"))


def admission(reasons: DataFrame) -> DataFrame:
    """status, n_reasons of rows (reason, hard): refuse on any hard reason, degraded on any other, else ok."""
    hard = F.count_if("hard")
    soft = F.count("*") - hard
    return reasons.agg(F.when(hard > 0, "refuse").when(soft > 0, "degraded").otherwise("ok").alias("status"), F.when(hard > 0, hard).otherwise(soft).alias("n_reasons"))


def replay_flags(transactions: DataFrame) -> DataFrame:
    """J3: transactions of the catalog that recovery left with replay_required."""
    return transactions.where("replay_required").select(F.lit("J3").alias("code"), F.lit("journal").alias("kind"), F.col("tx").cast("string").alias("entity"))


def readiness(draining: Column, admission_status: Column, startup_error: Column, requires_replay: Column) -> Column:
    return F.when(draining, "draining").when(admission_status == "refuse", "startup refused").when(startup_error != "", "startup error").when(requires_replay, "journal requires replay").otherwise("ready")


def state_code(state: Column) -> Column:
    """Codes 1 to 7 of the states; 0 for an unknown one."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in STATES]), state), F.lit(0)), F.lit(0))


def export(journal: DataFrame) -> DataFrame:
    """One row: total_records, incomplete_txs, requires_replay."""
    t = journal.groupBy("tx").agg(F.count("*").alias("n"), F.max_by("state", "seq").alias("last"))
    open_ = F.count_if(~F.col("last").isin("committed", "aborted"))
    return t.agg(F.sum("n").alias("total_records"), open_.alias("incomplete_txs"), (open_ > 0).alias("requires_replay"))


def visible(plan: DataFrame) -> DataFrame:
    """tx, recovered: writes that a reader sees once recovery ran, and whether it took recovery to see them."""
    return plan.where("action IN ('reconcile', 'roll-forward')").select("tx", (F.col("action") != "reconcile").alias("recovered"))
