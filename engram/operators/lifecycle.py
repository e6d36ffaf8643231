"""Lifecycle of memories as pure transitions of (deleted_at_ms, expires_at_ms).

One operation a key is a projection; many operations a key are folded in order
within the key's own sorted list by a native aggregate, without Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.errors import ValidationError
from engram.functions.clock import clamped_expiry, expires_at
from engram.schemas import AUDIT_RETENTION_DAYS, DAY_MS, FORGET_GRACE_DAYS, PURGE_BATCH

OPERATIONS = ("reinforce", "forget", "restore", "hard_delete")
GRACE_MS = FORGET_GRACE_DAYS * DAY_MS


def _live(deleted: Column, expires: Column, now: Column) -> Column:
    return deleted.isNull() & (expires > now)


def applies(op: Column, deleted: Column, expires: Column, now: Column) -> Column:
    """Whether an operation has an effect on a row that is there."""
    return (
        F.when(op.isin("reinforce", "forget"), _live(deleted, expires, now))
        .when(op == "restore", deleted.isNotNull() & (deleted > now - GRACE_MS))
        .when(op == "hard_delete", F.lit(True))
        .otherwise(F.lit(False))
    )


def _after(op: Column, deleted: Column, expires: Column, importance: Column, now: Column) -> tuple[Column, Column]:
    new_deleted = F.when(op == "forget", now).when(op == "restore", F.lit(None).cast("long")).otherwise(deleted)
    new_expires = F.when(op.isin("reinforce", "restore"), expires_at(importance, now)).when(op == "forget", clamped_expiry(expires, now)).otherwise(expires)
    return new_deleted, new_expires


def apply_one(memories: DataFrame, op: str, keys: Column, *, now_ms: int) -> DataFrame:
    """``brain_id, memory_id, outcome, deleted_at_ms, expires_at_ms, removed`` of the rows that ``keys`` holds for."""
    if op not in OPERATIONS:
        raise ValidationError(f"unknown operation {op!r}")
    now, name = F.lit(now_ms).cast("long"), F.lit(op)
    d, e = F.col("deleted_at_ms"), F.col("expires_at_ms")
    done = applies(name, d, e, now)
    new_d, new_e = _after(name, d, e, F.col("importance"), now)
    return memories.where(keys).select(
        "brain_id",
        "memory_id",
        F.when(done, "applied").otherwise("not_found").alias("outcome"),
        F.when(done, new_d).otherwise(d).alias("deleted_at_ms"),
        F.when(done, new_e).otherwise(e).alias("expires_at_ms"),
        (done & F.lit(op == "hard_delete")).alias("removed"),
    )


def fold(memories: DataFrame, ops: DataFrame) -> DataFrame:
    """Apply ``ops`` (``op_seq, brain_id, memory_id, op, at_ms``) in order of ``op_seq``.

    Out: ``brain_id, memory_id, known, removed, deleted_at_ms, expires_at_ms,
    outcomes``, the last an array of (op_seq, op, outcome). Keys without a row
    are unknown and all their outcomes are not_found.
    """
    listed = ops.groupBy("brain_id", "memory_id").agg(F.array_sort(F.collect_list(F.struct("op_seq", "op", "at_ms"))).alias("_ops"))
    rows = listed.join(memories.select("brain_id", "memory_id", "importance", "deleted_at_ms", "expires_at_ms", F.lit(True).alias("_known")), ["brain_id", "memory_id"], "left")
    outcome = "array<struct<op_seq:bigint,op:string,outcome:string>>"
    start = F.struct(F.coalesce("_known", F.lit(False)).alias("there"), F.col("deleted_at_ms").alias("d"), F.col("expires_at_ms").alias("e"), F.array().cast(outcome).alias("log"))
    importance = F.col("importance")

    def step(s: Column, x: Column) -> Column:
        now, op = x["at_ms"].cast("long"), x["op"]
        done = s["there"] & F.coalesce(applies(op, s["d"], s["e"], now), F.lit(False))
        d, e = _after(op, s["d"], s["e"], importance, now)
        said = F.struct(x["op_seq"].cast("long").alias("op_seq"), op.alias("op"), F.when(done, "applied").otherwise("not_found").alias("outcome"))
        return F.struct(
            (s["there"] & ~(done & (op == "hard_delete"))).alias("there"),
            F.when(done, d).otherwise(s["d"]).alias("d"),
            F.when(done, e).otherwise(s["e"]).alias("e"),
            F.concat(s["log"], F.array(said)).alias("log"),
        )

    s = F.aggregate("_ops", start, step)
    known = F.coalesce("_known", F.lit(False))
    return rows.select("brain_id", "memory_id", known.alias("known"), s.alias("s")).select(
        "brain_id", "memory_id", "known", (F.col("known") & ~F.col("s.there")).alias("removed"), F.col("s.d").alias("deleted_at_ms"), F.col("s.e").alias("expires_at_ms"), F.col("s.log").alias("outcomes")
    )


def audit_of(folded: DataFrame, *, agent_id: str = "engine") -> DataFrame:
    """``brain_id, memory_id, agent_id, action, op_seq`` of the operations that were applied; only these are audited."""
    log = folded.select("brain_id", "memory_id", F.explode("outcomes").alias("o")).where("o.outcome = 'applied'")
    return log.select("brain_id", "memory_id", F.lit(agent_id).alias("agent_id"), F.col("o.op").alias("action"), F.col("o.op_seq").alias("op_seq"))


def purgeable(now_ms: int) -> Column:
    """Expired, or deleted longer ago than the grace period."""
    return (F.col("expires_at_ms") <= now_ms) | (F.col("deleted_at_ms").isNotNull() & (F.col("deleted_at_ms") + GRACE_MS < now_ms))


def purge_expired(memories: DataFrame, *, now_ms: int, max_rows: int = PURGE_BATCH) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, keys that go): at most ``max_rows`` go, those that expire first."""
    gone = memories.where(purgeable(now_ms)).orderBy("expires_at_ms", "brain_id", "memory_id").limit(max_rows).select("brain_id", "memory_id")
    return memories.join(gone, ["brain_id", "memory_id"], "left_anti"), gone


def purge_audit(events: DataFrame, *, now_ms: int, max_rows: int = PURGE_BATCH) -> tuple[DataFrame, DataFrame]:
    """The same for audit events past retention, of all brains, oldest first."""
    gone = events.where(F.col("event_at_ms") < now_ms - AUDIT_RETENTION_DAYS * DAY_MS).orderBy("event_at_ms", "event_id").limit(max_rows).select("event_id")
    return events.join(gone, "event_id", "left_anti"), gone
