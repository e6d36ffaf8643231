"""Classification of records to import against those that are there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.schemas import TTL_TOLERANCE_MS

#: What must be equal for a record to count as imported before.
PRESERVED = (
    "agent_id", "topic", "catalog", "summary", "content", "timeline_day", "period_start_ms", "period_end_ms",
    "created_at_ms", "updated_at_ms", "importance", "expires_at_ms", "deleted_at_ms", "metadata", "record_version",
)
AUDIT_PRESERVED = ("action", "event_at_ms", "detail_json")


def _same(columns: tuple[str, ...], a: str, b: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out &= F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def _classify(incoming: DataFrame, existing: DataFrame, keys: list[str], columns: tuple[str, ...], expired: Column) -> DataFrame:
    """Adds ``status``: expired, insert, skip or conflict. Within the input the first of a key (by ``seq``) counts as there."""
    body = lambda df: df.select(*keys, F.struct(*columns).alias("_old"))
    first = F.first(F.struct("seq", *columns)).over(Window.partitionBy(*keys, "_expired").orderBy("seq"))
    rows = incoming.withColumn("_new", F.struct(*columns)).withColumn("_expired", F.coalesce(expired, F.lit(False))).withColumn("_first", first)
    joined = rows.join(body(existing), keys, "left")
    before = F.col("_old").isNotNull()
    status = (
        F.when(F.col("_expired"), "expired")
        .when(before & _same(columns, "_old", "_new"), "skip")
        .when(before, "conflict")
        .when(F.col("_first.seq") == F.col("seq"), "insert")
        .when(_same(columns, "_first", "_new"), "skip")
        .otherwise("conflict")
    )
    return joined.withColumn("status", status).drop("_new", "_old", "_first", "_expired")


def classify_memories(incoming: DataFrame, existing: DataFrame, *, started_ms: int) -> DataFrame:
    """``incoming`` (with ``seq``) and its status. Records that expire at ``started_ms`` or before are skipped as expired."""
    return _classify(incoming, existing, ["brain_id", "memory_id"], PRESERVED, F.col("expires_at_ms") <= started_ms)


def classify_audit(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    return _classify(incoming, existing, ["event_id"], AUDIT_PRESERVED, F.lit(False))


def counters(classified: DataFrame) -> DataFrame:
    """One row ``imported, skipped, failed``; expired ones count as skipped."""
    status = F.col("status")
    return classified.agg(
        F.count_if(status == "insert").alias("imported"), F.count_if(status.isin("skip", "expired")).alias("skipped"), F.count_if(status == "conflict").alias("failed")
    )


def idempotency_key(kind: str, brain: Column, name: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), brain, name)


def remaining_ttl(expires: Column, exported_at_ms: int) -> Column:
    return F.greatest(F.lit(0).cast("long"), expires - exported_at_ms)


def ttl_agrees(recorded: Column, expires: Column, exported_at_ms: int) -> Column:
    """Whether a record's time left is that of its expiry, within the format's tolerance."""
    return F.abs(recorded - remaining_ttl(expires, exported_at_ms)) <= TTL_TOLERANCE_MS
