"""Table schemas and the fixed values of the retrieval contract."""

from __future__ import annotations

from pyspark.sql import types as T

DAY_MS = 86_400_000

#: Fixed values of the contract.
TTL_DAYS = {5: 365, 4: 180, 3: 90, 2: 30, 1: 7}
FORGET_GRACE_DAYS = 30
AUDIT_RETENTION_DAYS = 90
TOP_K = 5
BRANCH_LIMIT = 50
MICRO_COSINE_FLOOR = 300_000
RRF_K = 60
BM25_WEIGHTS = {"topic": 5.0, "summary": 3.0, "content": 1.0}
BM25_K1, BM25_B = 1.2, 0.75
TOKEN_BUDGETS = {"topic": 12, "document": 256, "query": 128, "content": 1024}
RECENT_DEFAULT, RECENT_MAX = 20, 100
AUDIT_DEFAULT, AUDIT_MAX = 500, 500
PURGE_BATCH = 500
TTL_TOLERANCE_MS = 1000
AUDIT_ACTIONS = ("remember", "reinforce", "forget", "restore", "hard_delete")
FORBIDDEN_AUDIT_KEYS = ("topic", "summary", "content", "metadata")

MEMORIES = T.StructType(
    [
        T.StructField("memory_id", T.StringType(), False),
        T.StructField("brain_id", T.StringType(), False),
        T.StructField("agent_id", T.StringType(), False),
        T.StructField("topic", T.StringType(), False),
        T.StructField("catalog", T.StringType(), False),
        T.StructField("summary", T.StringType(), False),
        T.StructField("content", T.StringType(), False),
        T.StructField("timeline_day", T.StringType(), False),
        T.StructField("period_start_ms", T.LongType()),
        T.StructField("period_end_ms", T.LongType()),
        T.StructField("created_at_ms", T.LongType(), False),
        T.StructField("updated_at_ms", T.LongType(), False),
        T.StructField("importance", T.IntegerType(), False),
        T.StructField("expires_at_ms", T.LongType(), False),
        T.StructField("deleted_at_ms", T.LongType()),
        T.StructField("metadata", T.StringType(), False),
        T.StructField("profile_id", T.StringType(), False),
        T.StructField("record_version", T.IntegerType(), False),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)

AUDIT_EVENTS = T.StructType(
    [
        T.StructField("event_id", T.StringType(), False),
        T.StructField("brain_id", T.StringType(), False),
        T.StructField("memory_id", T.StringType(), False),
        T.StructField("agent_id", T.StringType(), False),
        T.StructField("action", T.StringType(), False),
        T.StructField("event_at_ms", T.LongType(), False),
        T.StructField("timeline_day", T.StringType(), False),
        T.StructField("detail_json", T.StringType(), False),
    ]
)

IMPORT_RUNS = T.StructType(
    [
        T.StructField("export_id", T.StringType(), False),
        T.StructField("artifact_sha256", T.StringType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("started_at_ms", T.LongType(), False),
        T.StructField("completed_at_ms", T.LongType()),
        T.StructField("last_committed_seq", T.LongType(), False),
        T.StructField("imported_count", T.LongType(), False),
        T.StructField("skipped_count", T.LongType(), False),
        T.StructField("failed_count", T.LongType(), False),
    ]
)

PROFILES = T.StructType(
    [
        T.StructField("profile_id", T.StringType(), False),
        T.StructField("revision", T.StringType(), False),
        T.StructField("input_version", T.IntegerType(), False),
        T.StructField("dimension", T.IntegerType(), False),
    ]
)

LIFECYCLE = T.StructType(
    [
        T.StructField("brain_id", T.StringType(), False),
        T.StructField("memory_id", T.StringType(), False),
        T.StructField("op_seq", T.LongType(), False),
        T.StructField("op", T.StringType(), False),
        T.StructField("at_ms", T.LongType(), False),
        T.StructField("deleted_at_ms", T.LongType()),
        T.StructField("expires_at_ms", T.LongType()),
        T.StructField("removed", T.BooleanType(), False),
    ]
)

PREVIEW = ("memory_id", "topic", "catalog", "summary", "timeline_day", "importance", "has_content")
