"""An event-sourced store of plain Parquet.

``memories/`` and ``audit/`` are appended to and never changed; ``lifecycle/``
has one row for each operation that was applied. The current state is the newest
lifecycle row of a key over its memory row. A commit writes new files into a
folder of its own and then names it in a manifest, which replaces the old one by
an atomic rename; readers see the old state or the new one. Writers hold a lock
file with their name and the end of their lease: a lock whose lease is over is
taken over, and a writer that lost its lock so cannot commit. What a change
depends on is read and judged under the lock (``transaction``). One writer at a
time is a deliberate limit of plain Parquet.

Paths go through Hadoop's file systems, so the store can be anywhere Spark reads.
"""

from __future__ import annotations

import json
import random
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.errors import BusyError, DuplicateKeyError, StoreError, ValidationError
from engram.operators import constraints, lifecycle
from engram.operators.blocks import BlockIndex
from engram.schemas import AUDIT_EVENTS, IMPORT_RUNS, LIFECYCLE, MEMORIES, PROFILES, PURGE_BATCH

VERSION = 1
TABLES = {"memories": MEMORIES, "lifecycle": LIFECYCLE, "audit": AUDIT_EVENTS, "imports": IMPORT_RUNS, "profiles": PROFILES}
ATTEMPTS, FIRST_WAIT_S, LEASE_S = 5, 0.05, 900.0


class Store:
    version = VERSION

    def __init__(self, spark: SparkSession, path: str, *, read_only: bool = False, create: bool = True, lease_s: float = LEASE_S) -> None:
        self.spark, self.path, self.read_only, self.lease_s = spark, path.rstrip("/"), read_only, lease_s
        self._mutex, self._owner = threading.RLock(), ""
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not self._fs.exists(self._path(f"{self.path}/_CURRENT")):
            if read_only or not create:
                raise StoreError(f"no store at {path}")
            with self.transaction():
                if not self._fs.exists(self._path(f"{self.path}/_CURRENT")):
                    self._swap({"version": VERSION, "op_seq": 0, "parts": {t: [] for t in TABLES}, "index": []})
        self._current()

    # -------------------------------------------------------------- the manifest

    def _read(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.path}/{name}"))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _current(self) -> dict:
        found = json.loads(self._read("_CURRENT"))
        if found.get("version") != VERSION:
            raise StoreError(f"store version {found.get('version')}, not {VERSION}")
        if missing := set(TABLES) - set(found["parts"]):
            raise StoreError(f"tables missing: {sorted(missing)}")
        return found

    def _swap(self, state: dict) -> None:
        if self._holder()[0] != self._owner:
            raise BusyError("the lock was taken over when its lease was over")
        new = self._path(f"{self.path}/_NEW-{uuid.uuid4().hex}")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        out.close()
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(new, self._path(f"{self.path}/_CURRENT"), options)

    def _holder(self) -> tuple[str, float]:
        """Who holds the lock, and until when; a lock without a name is held for a lease from its making on."""
        try:
            made = self._fs.getFileStatus(self._path(f"{self.path}/_LOCK")).getModificationTime() / 1000
            text = self._read("_LOCK")
        except Exception:  # it has just been released
            return "", 0.0
        try:
            found = json.loads(text)
            return found["owner"], found["until"]
        except (ValueError, KeyError):
            return "?", made + self.lease_s

    def _take(self) -> None:
        lock, me = self._path(f"{self.path}/_LOCK"), uuid.uuid4().hex
        self._fs.mkdirs(self._path(self.path))
        for n in range(ATTEMPTS):
            try:
                out = self._fs.create(lock, False)
            except Exception as e:
                if not self._fs.exists(self._path(self.path)):
                    raise StoreError(str(e)) from e
            else:
                out.write(bytearray(json.dumps({"owner": me, "until": time.time() + self.lease_s}).encode()))
                out.close()
                self._owner = me
                return
            who, until = self._holder()
            if who and until < time.time():  # one of several takers moves it away; its writer cannot commit any more
                old = self._path(f"{self.path}/_OLD-{uuid.uuid4().hex}")
                if self._fs.rename(lock, old):
                    self._fs.delete(old, False)
                continue
            if n < ATTEMPTS - 1:
                time.sleep(FIRST_WAIT_S * 2**n * random.uniform(0.5, 1.5))
        raise BusyError("another writer holds the store")

    @contextmanager
    def transaction(self) -> Iterator[None]:
        """Hold the lock; commits inside are this writer's, and what they depend on does not change meanwhile."""
        if self.read_only:
            raise StoreError("the store is open for reading only")
        with self._mutex:
            if self._owner:
                yield
                return
            self._take()
            try:
                yield
            finally:
                mine = self._holder()[0] == self._owner
                self._owner = ""
                if mine:
                    self._fs.delete(self._path(f"{self.path}/_LOCK"), False)

    # -------------------------------------------------------------- tables

    def table(self, name: str) -> DataFrame:
        parts = [f"{self.path}/{p}" for p in self._current()["parts"][name]]
        return self.spark.read.schema(TABLES[name]).parquet(*parts) if parts else self.spark.createDataFrame([], TABLES[name])

    def memories(self, brain_id: str | None = None, memory_id: str | None = None) -> DataFrame:
        """Current state of all rows that are not removed, or of a brain's or one key's; the key is sought in the files first."""
        key = F.lit(True)
        for name, value in (("brain_id", brain_id), ("memory_id", memory_id)):
            if value is not None:
                key &= F.col(name) == value
        newest = self.table("lifecycle").where(key).groupBy("brain_id", "memory_id").agg(F.max_by(F.struct("deleted_at_ms", "expires_at_ms", "removed"), "op_seq").alias("_l"))
        rows = self.table("memories").where(key).join(newest, ["brain_id", "memory_id"], "left").where(~F.coalesce(F.col("_l.removed"), F.lit(False)))
        state = {c: F.when(F.col("_l").isNotNull(), F.col(f"_l.{c}")).otherwise(F.col(c)) for c in ("deleted_at_ms", "expires_at_ms")}
        return rows.withColumns(state).select(*MEMORIES.names)

    def reindex(self) -> BlockIndex:
        """Write the lexical index of what is stored now anew; from then on it is kept with every commit."""
        with self.transaction():
            state = self._current()
            index = BlockIndex.build(self.memories(), f"{self.path}/index")
            self._swap(state | {"index": index.state()["segments"]})
            return index

    def index(self) -> BlockIndex | None:
        """The index of the rows that are there now; only a store of an older make has none until ``reindex``."""
        return self._index_of(self._current())

    def _index_of(self, state: dict) -> BlockIndex | None:
        return BlockIndex.of_state(self.spark, {"path": f"{self.path}/index", "segments": state["index"]}) if "index" in state else None

    def commit(self, op_seq: int | None = None, **tables: DataFrame) -> None:
        """Append to several tables at once."""
        with self.transaction():
            self._commit(op_seq, tables)

    def _commit(self, op_seq: int | None, tables: dict[str, DataFrame], replace: bool = False, removed: DataFrame | None = None) -> None:
        """``removed`` are the rows that go with this commit: their texts leave the index, as those of new ones enter it."""
        state = self._current()
        index = self._index_of(state)
        if index is not None and removed is not None:
            index = index.remove(removed)
        for name, df in tables.items():
            part = f"{name}/{uuid.uuid4().hex}"
            conformed = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name].fields))
            order = [c for c in ("brain_id", "memory_id", "event_id") if c in conformed.columns]
            (conformed.sortWithinPartitions(*order) if order else conformed).write.parquet(f"{self.path}/{part}")
            state["parts"][name] = [part] if replace else [*state["parts"][name], part]
            if index is not None and name == "memories" and not replace:
                index = index.append(self.spark.read.schema(MEMORIES).parquet(f"{self.path}/{part}"))
        if index is not None:
            state["index"] = index.merged().state()["segments"]
        if op_seq is not None:
            state["op_seq"] = op_seq
        self._swap(state)

    def append_memories(self, rows: DataFrame, audit: DataFrame | None = None, *, dim: int | None = None) -> None:
        """Add rows whose keys are new, checked before anything is written."""
        with self.transaction():
            bad = constraints.validate(rows, constraints.memory_rules(dim))[1].select("memory_id", "violations").limit(5).collect()
            if bad:
                raise ValidationError(f"rows break rules: {[(r['memory_id'], r['violations']) for r in bad]}")
            keys = rows.select("brain_id", "memory_id")
            twice = constraints.duplicates(keys).limit(1).count()
            if twice or keys.join(self.memories().select("brain_id", "memory_id"), ["brain_id", "memory_id"], "left_semi").limit(1).count():
                raise DuplicateKeyError("a row with this key exists")
            self._commit(None, {"memories": rows} | ({"audit": audit} if audit is not None else {}))

    def append_lifecycle(self, changed: DataFrame, op: str, *, at_ms: int, audit: DataFrame | None = None) -> None:
        """Add states of ``brain_id, memory_id, deleted_at_ms, expires_at_ms, removed`` after ``op``."""
        with self.transaction():
            seq = self._current()["op_seq"] + 1
            rows = changed.select("brain_id", "memory_id", F.lit(seq).alias("op_seq"), F.lit(op).alias("op"), F.lit(at_ms).alias("at_ms"), "deleted_at_ms", "expires_at_ms", "removed")
            gone = self.memories().join(changed.select("brain_id", "memory_id"), ["brain_id", "memory_id"], "left_semi") if op in ("hard_delete", "purge") else None
            self._commit(seq, {"lifecycle": rows} | ({"audit": audit} if audit is not None else {}), removed=gone)

    def delete(self, path: str) -> None:
        """Remove a scratch folder of this store."""
        if not path.startswith(f"{self.path}/staging/"):
            raise StoreError(f"no scratch folder of this store: {path}")
        self._fs.delete(self._path(path), True)

    def imports(self) -> DataFrame:
        """The newest row of each import run."""
        w = Window.partitionBy("export_id").orderBy(F.desc("last_committed_seq"), F.col("completed_at_ms").desc_nulls_last())
        return self.table("imports").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

    def compact(self) -> None:
        """Fold the log: current rows become the memories, the lifecycle log starts anew."""
        with self.transaction():
            self._commit(None, {"memories": self.memories(), "lifecycle": self.spark.createDataFrame([], LIFECYCLE)}, replace=True)

    def purge_audit(self, *, now_ms: int, max_rows: int = PURGE_BATCH) -> int:
        """Remove audit events past retention, at most ``max_rows``, oldest first; how many went."""
        with self.transaction():
            events = self.table("audit")
            kept, gone = lifecycle.purge_audit(events, now_ms=now_ms, max_rows=max_rows)
            n = gone.count()
            if n:
                self._commit(None, {"audit": kept}, replace=True)
            return n
