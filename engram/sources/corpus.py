"""Memories and audit events derived from generic document, vector and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions.clock import expires_at, timeline_day
from engram.schemas import AUDIT_ACTIONS, DAY_MS

CATALOGS = ("bug", "decision", "preference", "fact", "note", "task")
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
NOW_MS = 1_706_745_600_000
PROFILE = "hash-64"
HOURS_A_YEAR = 8760


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str, *, now_ms: int = NOW_MS, vectors: bool = True) -> DataFrame:
    """One memory a document: its first line is the summary, the rest of its text the content.

    All columns are expressions, so unused ones are never read. Documents are dealt all vectors in turn.
    """
    d = F.col("doc_id")
    # Ages repeat after a year, so that the live share of the rows is the same at any size.
    created = F.lit(now_ms) - (d % HOURS_A_YEAR) * 3_600_000
    text = F.coalesce(F.col("text"), F.lit(""))
    first = F.substring_index(text, "\n", 1)
    deleted = F.when(d % 17 == 0, created + DAY_MS)
    docs = read(spark, sf_dir, "documents").select(
        F.concat(F.lit("m"), F.lpad(d.cast("string"), 8, "0")).alias("memory_id"),
        F.col("lang").alias("brain_id"),
        F.lit("corpus").alias("agent_id"),
        F.col("source").alias("topic"),
        F.element_at(F.array(*map(F.lit, CATALOGS)), (d % len(CATALOGS) + 1).cast("int")).alias("catalog"),
        first.alias("summary"),
        F.substr(text, F.length(first) + 2).alias("content"),
        timeline_day(created).alias("timeline_day"),
        F.lit(None).cast("long").alias("period_start_ms"),
        F.lit(None).cast("long").alias("period_end_ms"),
        created.alias("created_at_ms"),
        created.alias("updated_at_ms"),
        (d % 5 + 1).cast("int").alias("importance"),
        expires_at(d % 5 + 1, created).alias("expires_at_ms"),
        deleted.alias("deleted_at_ms"),
        F.lit("{}").alias("metadata"),
        F.lit(PROFILE).alias("profile_id"),
        F.lit(1).alias("record_version"),
        d.alias("_vec"),
    )
    if not vectors:
        return docs.drop("_vec")
    emb = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_vec"), "embedding")
    n = max(emb.count(), 1)
    return docs.withColumn("_vec", F.col("_vec") % n).join(emb, "_vec", "left").drop("_vec")


def audit_events(spark: SparkSession, sf_dir: str, *, tz: str = "UTC") -> DataFrame:
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    n = max(read(spark, sf_dir, "documents").count(), 1)
    index = F.array_position(F.array(*map(F.lit, EVENT_TYPES)), F.col("event_type"))
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("e"), F.lpad(F.col("event_id").cast("string"), 10, "0")).alias("event_id"),
        F.element_at(F.array(*map(F.lit, ("en", "de", "fr", "es"))), (F.col("user_id") % 4 + 1).cast("int")).alias("brain_id"),
        F.concat(F.lit("m"), F.lpad((F.col("event_id") % n).cast("string"), 8, "0")).alias("memory_id"),
        F.concat(F.lit("agent"), (F.col("user_id") % 3).cast("string")).alias("agent_id"),
        F.element_at(F.array(*map(F.lit, AUDIT_ACTIONS)), index.cast("int")).alias("action"),
        at.alias("event_at_ms"),
        timeline_day(at, tz).alias("timeline_day"),
        F.col("props").alias("detail_json"),
    )
