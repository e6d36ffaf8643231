"""Resumable import of an export into a store.

A run is keyed by export id and by the file's hash. The export is checked and
staged as a table (``exports``); a range of its lines is then judged against the
store by one join and committed together with its checkpoint, so a run that
breaks off goes on after the last range, and a range is never written twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.errors import ImportConflictError
from engram.functions import clock
from engram.functions.embedding import Embedder, HashingEmbedder, embed
from engram.functions.text import document_payload
from engram.operators import imports
from engram.schemas import IMPORT_RUNS
from engram.sources.exports import StagedExport, stage
from engram.sources.jsonl import FORMAT
from engram.sources.store import Store

#: Lines that are judged and committed together.
RANGE_LINES = 1_000_000


@dataclass(frozen=True)
class ImportReport:
    export_id: str
    status: str
    imported: int
    skipped: int
    failed: int

    def line(self) -> str:
        return f"import {self.export_id}: {self.status} imported={self.imported} skipped={self.skipped} failed={self.failed}"


class Importer:
    def __init__(self, store: Store, *, embedder: Embedder | None = None, profile_id: str = "hash-64", tz: str = "UTC", batch: int = RANGE_LINES, format_name: str = FORMAT, after_batch: Callable[[int], None] | None = None) -> None:
        self.store, self.embedder = store, embedder or HashingEmbedder()
        self.profile_id, self.tz, self.batch, self.format_name, self.after_batch = profile_id, tz, batch, format_name, after_batch

    def import_file(self, path: str, *, now_ms: int) -> ImportReport:
        """Import one export. Raises on a broken file or a conflict; the same completed export again is no work."""
        staged = stage(self.store.spark, path, f"{self.store.path}/staging", format_name=self.format_name)
        try:
            return self._import(staged, now_ms)
        finally:
            self.store.delete(staged.path)

    def _import(self, export: StagedExport, now_ms: int) -> ImportReport:
        known = {(r["export_id"], r["artifact_sha256"]): r for r in self.store.imports().where((F.col("export_id") == export.export_id) | (F.col("artifact_sha256") == export.artifact_sha256)).collect()}
        run = known.pop((export.export_id, export.artifact_sha256), None)
        if known:
            raise ImportConflictError("this export id or file was imported with another file or id")
        if run is not None and run["status"] == "completed":
            return ImportReport(export.export_id, "noop", run["imported_count"], run["skipped_count"], run["failed_count"])
        started = run["started_at_ms"] if run is not None else now_ms
        done, imported, skipped = (run["last_committed_seq"], run["imported_count"], run["skipped_count"]) if run is not None else (0, 0, 0)
        total = export.manifest["memory_count"] + export.manifest["audit_count"]
        if run is None:
            self.store.commit(imports=self._run(export, "running", started, None, 0, 0, 0, 0))
        while done < total:
            end = min(done + self.batch, total)
            try:
                with self.store.transaction():  # judged and written under one lock
                    a, b = self._range(export, done, end, started, imported, skipped)
            except ImportConflictError:
                self.store.commit(imports=self._run(export, "failed", started, None, done, imported, skipped, 1))
                raise
            imported, skipped, done = imported + a, skipped + b, end
            if self.after_batch:
                self.after_batch(done)
        self.store.commit(imports=self._run(export, "completed", started, now_ms, done, imported, skipped, 0))
        return ImportReport(export.export_id, "completed", imported, skipped, 0)

    def _run(self, export: StagedExport, status: str, started: int, completed: int | None, seq: int, imported: int, skipped: int, failed: int) -> DataFrame:
        return self.store.spark.createDataFrame([(export.export_id, export.artifact_sha256, status, started, completed, seq, imported, skipped, failed)], IMPORT_RUNS)

    def _range(self, export: StagedExport, start: int, end: int, started: int, imported: int, skipped: int) -> tuple[int, int]:
        tables, a, b = {}, 0, 0
        n = export.manifest["memory_count"]
        if start < n:
            rows = export.records("memory", start, end).withColumn("profile_id", F.lit(self.profile_id))
            judged = imports.classify_memories(rows, self.store.memories(), started_ms=started)
            fresh = judged.where("status = 'insert'").withColumn("embedding", embed(document_payload(F.col("topic"), F.col("summary")), self.embedder))
            a, b, tables = self._judge(judged, a, b, tables, "memories", fresh)
        if end > n:
            rows = export.records("audit", start, end).withColumn("timeline_day", clock.timeline_day(F.col("event_at_ms"), self.tz))
            judged = imports.classify_audit(rows, self.store.table("audit"))
            a, b, tables = self._judge(judged, a, b, tables, "audit", judged.where("status = 'insert'"))
        tables["imports"] = self._run(export, "running", started, None, end, imported + a, skipped + b, 0)
        self.store.commit(**tables)
        return a, b

    @staticmethod
    def _judge(judged: DataFrame, a: int, b: int, tables: dict, name: str, fresh: DataFrame) -> tuple[int, int, dict]:
        c = imports.counters(judged).first()
        if c["failed"]:
            raise ImportConflictError(f"{c['failed']} {name} exist with other content")
        return a + c["imported"], b + c["skipped"], tables | ({name: fresh} if c["imported"] else {})
