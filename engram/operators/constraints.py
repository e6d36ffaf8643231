"""Constraints on records as one Boolean column a rule, and integrity reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.errors import ProfileMismatchError
from engram.functions.jsons import is_object
from engram.functions.text import strip
from engram.functions.vectors import well_formed
from engram.operators.lexical import postings
from engram.schemas import AUDIT_ACTIONS


def memory_rules(dim: int | None = None) -> dict[str, Column]:
    """Each holds for a good row; null counts as broken."""
    filled = {f"{c}_filled": strip(F.col(c)) != "" for c in ("memory_id", "brain_id", "agent_id", "topic", "catalog", "summary", "profile_id")}
    ordered = F.col("period_start_ms").isNull() | F.col("period_end_ms").isNull() | (F.col("period_start_ms") <= F.col("period_end_ms"))
    rules = filled | {
        "content_present": F.col("content").isNotNull(),
        "day_shape": F.col("timeline_day").rlike(r"\A\d{4}-\d{2}-\d{2}\z"),
        "importance_range": F.col("importance").between(1, 5),
        "metadata_object": is_object(F.col("metadata")),
        "period_ordered": ordered,
        "updated_after_created": F.col("updated_at_ms") >= F.col("created_at_ms"),
        "version_positive": F.col("record_version") >= 1,
    }
    if dim is not None:
        rules["vector_well_formed"] = F.col("embedding").isNull() | well_formed(F.col("embedding"), dim)
    return rules


def audit_rules() -> dict[str, Column]:
    filled = {f"{c}_filled": strip(F.col(c)) != "" for c in ("event_id", "brain_id", "memory_id", "agent_id")}
    return filled | {"action_known": F.col("action").isin(*AUDIT_ACTIONS), "day_shape": F.col("timeline_day").rlike(r"\A\d{4}-\d{2}-\d{2}\z"), "detail_object": is_object(F.col("detail_json"))}


def import_run_rules() -> dict[str, Column]:
    counters = reduce(lambda a, b: a & b, (F.col(c) >= 0 for c in ("last_committed_seq", "imported_count", "skipped_count", "failed_count")))
    return {
        "sha_shape": F.col("artifact_sha256").rlike(r"\A[0-9a-f]{64}\z"),
        "status_known": F.col("status").isin("running", "completed", "failed"),
        "counters": counters,
        "running_is_open": (F.col("status") != "running") | F.col("completed_at_ms").isNull(),
    }


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``df`` with ``violations``, the names of broken rules in order."""
    broken = F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()))
    return df.withColumn("violations", F.filter(broken, lambda x: x.isNotNull()))


def validate(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with their violations)."""
    checked = violations(df, rules)
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)


def counted(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rule, n``: rows that break each rule, of the rules that any row breaks."""
    return violations(df, rules).select(F.explode("violations").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def fail_fast(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``df``, raising when a broken row is read."""
    checked = violations(df, rules)
    return checked.withColumn("_ok", F.assert_true(F.size("violations") == 0, F.array_join("violations", ","))).where(F.col("_ok").isNull()).drop("_ok", "violations")


def orphans(memories: DataFrame, profiles: DataFrame) -> DataFrame:
    """Rows whose profile is not there; must be empty. The profile table has a row or two."""
    return memories.join(F.broadcast(profiles.select("profile_id")), "profile_id", "left_anti")


def duplicates(memories: DataFrame) -> DataFrame:
    """Keys that occur more than once."""
    return memories.groupBy("brain_id", "memory_id").agg(F.count("*").alias("n")).where("n > 1")


def index_parity(memories: DataFrame, index: DataFrame) -> DataFrame:
    """``side, brain_id, memory_id, term, tf, len`` where a stored index and a fresh one differ."""
    fresh = postings(memories).select("brain_id", "memory_id", "term", "tf", "len")
    # Both sides are read once and meet in one aggregation.
    both = fresh.withColumn("_n", F.lit(1).cast("long")).unionByName(index.select(*fresh.columns, F.lit(-1).cast("long").alias("_n")))
    off = both.groupBy(*fresh.columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    side = F.when(F.col("_n") > 0, F.lit("missing")).otherwise(F.lit("extra"))
    return off.select(side.alias("side"), *fresh.columns, F.explode(F.sequence(F.lit(1), F.abs("_n")))).drop("col")


def integrity(memories: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row: memories, profiles, orphans, rows without a vector."""
    known = F.broadcast(profiles.select("profile_id", F.lit(1).alias("_known")).distinct())
    counts = memories.join(known, "profile_id", "left").agg(
        F.count("*").alias("memories"), F.count_if(F.col("_known").isNull()).alias("orphans"), F.count_if(F.col("embedding").isNull()).alias("without_vector")
    )
    return counts.join(F.broadcast(profiles.agg(F.count("*").alias("profiles"))))


def register_profile(stored: DataFrame, wanted: dict[str, object]) -> str:
    """``new`` for an empty table, ``same`` for the one equal profile; anything else is an error."""
    rows = stored.limit(2).collect()
    if not rows:
        return "new"
    if len(rows) > 1 or any(rows[0][k] != v for k, v in wanted.items()):
        raise ProfileMismatchError(f"the store holds {[r.asDict() for r in rows]}, not {wanted}")
    return "same"
