"""Recovery as folds over transactions: what replay appends to the journal and does to the catalog, for all of them at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is appended from a state to the end.
STEPS = {"data-written": "parity-written>metadata-written>committed", "replay-required": "parity-written>metadata-written>committed", "parity-written": "metadata-written>committed", "metadata-written": "committed"}


def roll_forward(plan: DataFrame, extents: DataFrame, groups: DataFrame) -> DataFrame:
    """tx, outcome, records, parity_recomputed of every transaction whose action is roll-forward.

    ``extents``: tx, extent_no, pg, own (written by this transaction, or a committed peer in one of its groups), sound,
    parity_ok, others_ok (all other members of the group are sound). ``groups``: pg, stale (its digest isn't that of its file).

    Own extents are verified; one that is lost is rebuilt only if parity was already written. Parity is computed again after
    data-written, and after parity-written where a digest is stale; a committed peer that can't be read then aborts the
    transaction, so that corruption isn't folded into new parity. A transaction without extents has no payload and fails.
    """
    t = plan.where("action = 'roll-forward'").select("tx", F.col("effective_state").alias("state"))
    x = extents.join(groups.select("pg", "stale"), "pg", "left")
    x = x.groupBy("tx").agg(
        F.count_if("own").alias("n_own"),
        F.count_if(F.col("own") & ~F.col("sound")).alias("bad"),
        F.count_if(F.col("own") & ~F.col("sound") & F.col("parity_ok") & F.col("others_ok")).alias("mendable"),
        F.count_if(~F.col("own") & ~F.col("sound") & ~(F.col("parity_ok") & F.col("others_ok"))).alias("lost_peers"),
        F.bool_or(F.col("own") & F.coalesce("stale", F.lit(True))).alias("stale"),
    )
    t = t.join(x, "tx", "left").na.fill(0, ["n_own", "bad", "mendable", "lost_peers"]).na.fill(False, ["stale"])
    before = F.col("state").isin("data-written", "replay-required")
    recompute = before | ((F.col("state") == "parity-written") & F.col("stale"))
    broken = (F.col("n_own") == 0) | (before & (F.col("bad") > 0)) | (F.col("bad") > F.col("mendable"))
    outcome = F.when(broken, "failed").when(recompute & (F.col("lost_peers") > 0), "aborted").otherwise("committed")
    records = F.create_map(*[F.lit(v) for kv in STEPS.items() for v in kv])[F.col("state")]
    return t.select("tx", outcome.alias("outcome"), F.when(outcome == "failed", "").when(outcome == "aborted", "aborted").otherwise(records).alias("records"), (recompute & (outcome == "committed")).alias("parity_recomputed"))


def reconcile(groups: DataFrame, committed: DataFrame, parity_digests: DataFrame) -> DataFrame:
    """pg, members, checksum, generation of the groups after committed transactions are merged into the catalog.

    ``groups``: pg, members (array), checksum, generation. ``committed``: pg, extent_no of the transactions' extents. New members
    come after the old ones, each once, in order of their number; a group that gains some has its generation raised. A group that
    had a digest takes that of its parity file, or none if the file can't be read; a new group has none yet.
    """
    new = committed.groupBy("pg").agg(F.sort_array(F.collect_set("extent_no")).alias("new"))
    g = groups.join(new, "pg", "full_outer").join(parity_digests.select("pg", F.col("digest").alias("_digest")), "pg", "left")
    none = F.array().cast("array<bigint>")
    old, known = F.coalesce("members", none), F.col("generation").isNotNull()
    added = F.array_except(F.coalesce("new", none), old)
    generation = F.when(~known, 1).otherwise(F.col("generation") + (F.size(added) > 0).cast("int"))
    checksum = F.when(~known, "").when((F.col("checksum") != "") & F.col("new").isNotNull() & (generation > 0), F.coalesce("_digest", F.lit(""))).otherwise(F.col("checksum"))
    return g.select("pg", F.concat(old, added).alias("members"), checksum.alias("checksum"), generation.cast("long").alias("generation"))


def repair_replay(repairs: DataFrame) -> DataFrame:
    """tx, outcome, records of open repair transactions.

    ``repairs``: tx, kind (extent or parity), state (the effective one), rebuildable (the bytes can be computed), sound (what is on
    disk is right or, for an extent, can be made right). From prepared the bytes are written first; then they are verified.
    """
    prepared = F.col("state") == "prepared"
    known, open_ = F.col("kind").isin("extent", "parity"), F.col("state").isin("prepared", "data-written", "replay-required")
    ok = known & F.when(prepared, F.col("rebuildable")).otherwise(F.col("sound"))
    outcome = F.when(~known, "failed").when(~open_, "skipped").when(ok, "committed").otherwise("failed")
    records = F.when(outcome != "committed", "").when(prepared, "data-written>committed").otherwise("committed")
    return repairs.select("tx", outcome.alias("outcome"), records.alias("records"))


def metadata_replay(records: DataFrame) -> DataFrame:
    """tx, error of metadata transactions (tx, path, state): one that began and never ended is to be tried again."""
    scrub, rebuild = (F.col("path").startswith(f"metadata://{k}/") for k in ("scrub", "rebuild"))
    name = F.regexp_extract("path", r"^metadata://\w+/(.*)$", 1)
    error = (
        F.when(~scrub & ~rebuild, "unknown type").when(scrub & (name == ""), "missing run id").when(rebuild & (name == ""), "missing disk id")
        .when(F.col("state") == "prepared", "never completed")
    )
    return records.select("tx", error.alias("error"))


def maintenance_records(runs: DataFrame, kind: str, done: Column) -> DataFrame:
    """path, state: the journal rows of scrub or rebuild runs, a prepared one at the start and a committed one at the end."""
    path = F.concat(F.lit(f"metadata://{kind}/"), F.col("run").cast("string"))
    return runs.select(path.alias("path"), F.explode(F.when(done, F.array(F.lit("prepared"), F.lit("committed"))).otherwise(F.array(F.lit("prepared")))).alias("state"))


def record_violations(records: DataFrame) -> DataFrame:
    """J1: records (record_no, tx, state, payload, payload_checksum, checksum) whose digests aren't those of their bytes."""
    from ..functions.blake3 import blake3_hex

    payload = blake3_hex(F.col("payload")) != F.col("payload_checksum")
    whole = blake3_hex(F.concat(F.col("payload"), F.col("payload_checksum").cast("binary"))) != F.col("checksum")
    message = F.when(payload, "payload checksum").when(whole, "record checksum")
    entity = F.format_string("record[%d] tx=%s state=%s", F.col("record_no"), F.col("tx").cast("string"), F.col("state"))
    return records.select(F.lit("J1").alias("code"), entity.alias("entity"), message.alias("message")).where("message IS NOT NULL")
