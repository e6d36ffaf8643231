"""Structured Streaming counterparts: ingest that writes a record once, and a keyed lifecycle.

Both keep state by key with a timer, so what is kept grows with the keys of a
span of time and not with the stream's age.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from engram.operators.imports import PRESERVED
from engram.schemas import DAY_MS, FORGET_GRACE_DAYS, TTL_DAYS

#: State with timers needs this provider.
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEEP_MS = 7 * DAY_MS


def allow_timers(spark: SparkSession) -> None:
    """Have the session's streaming queries keep state in a provider that knows timers."""
    spark.conf.set(_PROVIDER, _ROCKS)


class Admission(StatefulProcessor):
    """Judges the records of one key: the first one of a span of time is new, equal ones are repeats, others conflict."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "body string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803, ANN001
        known = self.seen.get()[0] if self.seen.exists() else None
        first, n, body, conflict, arrived = None, 0, known, False, 0
        for r in rows:  # one record is held at a time, however often a batch repeats it
            n += 1
            conflict |= body is not None and r["body"] != body
            body = r["body"] if body is None else body
            arrived = max(arrived, r["arrived_ms"])
            if known is None and (first is None or r["seq"] < first["seq"]):
                first = r
        if known is None:
            self.seen.update((body,))
            self.handle.registerTimer(arrived + self.keep_ms)
        if conflict:
            yield Row(status="conflict", key="/".join(map(str, key)), n=n, record=None)
        elif first is not None:
            yield Row(status="insert", key=None, n=1, record=first["record"])
        if not conflict and n > (first is not None):
            yield Row(status="skip", key=None, n=n - (first is not None), record=None)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803, ANN001
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def admitted(source: DataFrame, *, started_ms: int, seq: str = "created_at_ms", keep_ms: int = KEEP_MS, arrival: Column | None = None, late: str = "1 hour") -> DataFrame:
    """``status, key, n, record`` of a stream of memories: a row for each new record, and how many were repeats.

    Records that expired by ``started_ms`` are left out. A key is remembered for
    ``keep_ms`` from its ``arrival`` (a timestamp; by default when its batch is
    read): repeats within that span are known, by the hash of what must be equal;
    of several in one batch the one of least ``seq`` counts as first. After it
    the key is forgotten, and its state is gone. An ``arrival`` of one's own may
    fall behind the latest one by ``late``; records further behind are left out.
    """
    allow_timers(source.sparkSession)
    body = F.sha2(F.to_json(F.struct(*PRESERVED)), 256)
    rows = source.where(F.col("expires_at_ms") > started_ms).withColumn("arrived", arrival if arrival is not None else F.current_timestamp()).withWatermark("arrived", late)
    keyed = rows.select("brain_id", "memory_id", "arrived", F.unix_millis("arrived").alias("arrived_ms"), F.col(seq).alias("seq"), body.alias("body"), F.struct(*source.columns).alias("record"))
    kind = source.select(F.struct(*source.columns).alias("r")).schema["r"].dataType.simpleString()
    return keyed.groupBy("brain_id", "memory_id").transformWithState(Admission(keep_ms), f"status string, key string, n bigint, record {kind}", "Append", "EventTime")


def ingest(source: DataFrame, target: str, checkpoint: str, *, started_ms: int, seq: str = "created_at_ms", keep_ms: int = KEEP_MS, arrival: Column | None = None, late: str = "1 hour") -> StreamingQuery:
    """Append new records of a stream to Parquet under ``target``, one folder a batch.

    A batch's folder is overwritten when the batch is run again, so each is
    written once in effect. What is new is told from the state (``admitted``), so
    a batch costs the same however much has been written before; a conflict stops
    the query.
    """

    def write(batch: DataFrame, number: int) -> None:
        # Raised where the row's own value is made, which no filter can be moved before.
        record = F.when(F.col("status") == "conflict", F.raise_error(F.concat(F.lit("conflict: "), F.col("key")))).otherwise(F.col("record"))
        batch.where("status <> 'skip'").select(record.alias("record")).select("record.*").write.mode("overwrite").parquet(f"{target}/batch_id={number}")

    judged = admitted(source, started_ms=started_ms, seq=seq, keep_ms=keep_ms, arrival=arrival, late=late)
    return judged.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_OUT = "brain_id string, memory_id string, op_seq bigint, op string, outcome string, deleted_at_ms bigint, expires_at_ms bigint"
_STATE = "importance int, deleted_at_ms bigint, expires_at_ms bigint, ends_ms bigint"


def step(state: tuple, op: str, at: int, importance: int | None) -> tuple[tuple, bool]:
    """One transition of (known, importance, deleted, expires); whether it applied."""
    known, imp, deleted, expires = state
    alive = known and deleted is None and expires > at
    if op == "remember":
        return ((True, importance, None, at + TTL_DAYS[importance] * DAY_MS), True) if not known else (state, False)
    if op == "reinforce" and alive:
        return (True, imp, None, at + TTL_DAYS[imp] * DAY_MS), True
    if op == "forget" and alive:
        return (True, imp, at, min(expires, at + FORGET_GRACE_DAYS * DAY_MS)), True
    if op == "restore" and known and deleted is not None and deleted > at - FORGET_GRACE_DAYS * DAY_MS:
        return (True, imp, None, at + TTL_DAYS[imp] * DAY_MS), True
    if op == "hard_delete" and known:
        return (False, None, None, None), True
    return state, False


def ends(deleted: int | None, expires: int) -> int:
    """When a row is past all that can be done to it: expired, or deleted and past its grace."""
    return expires if deleted is None else max(expires, deleted + FORGET_GRACE_DAYS * DAY_MS)


class Lifecycle(StatefulProcessor):
    """Operations on one key. Its state goes with a hard delete, and when the stream's time is past its end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803, ANN001
        held = self.row.get() if self.row.exists() else None
        current = (True, held[0], held[1], held[2]) if held else (False, None, None, None)
        out = []
        for r in sorted(rows, key=lambda r: r["op_seq"]):  # one key's operations of one micro-batch
            current, done = step(current, r["op"], r["at_ms"], r["importance"])
            out.append(Row(brain_id=key[0], memory_id=key[1], op_seq=r["op_seq"], op=r["op"], outcome="applied" if done else "not_found", deleted_at_ms=current[2], expires_at_ms=current[3]))
        known, importance, deleted, expires = current
        end = ends(deleted, expires) if known else None
        if held and held[3] != end:
            self.handle.deleteTimer(held[3])
        if known:
            if not held or held[3] != end:
                self.handle.registerTimer(end)
            self.row.update((importance, deleted, expires, end))
        elif held:
            self.row.clear()
        return iter(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803, ANN001
        self.row.clear()
        return iter(())

    def close(self) -> None:
        pass


def lifecycle_stream(ops: DataFrame, *, late: str = "1 hour") -> DataFrame:
    """Outcomes of a stream of ``brain_id, memory_id, op_seq, op, at_ms, importance``, state kept by key.

    The stream's time is the latest ``at_ms`` less what may come ``late``; later
    operations are left out. When it is past a row's end (expired; or deleted and
    past its grace) the row is purged, as ``purge_expired`` does in a table: its
    state goes, and the key is free again.
    """
    allow_timers(ops.sparkSession)
    timed = ops.withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", late)
    return timed.groupBy("brain_id", "memory_id").transformWithState(Lifecycle(), _OUT, "Append", "EventTime")
