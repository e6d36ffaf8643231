"""Large exports, read and checked by many tasks.

Lines are read by Spark's text reader, which splits a file by bytes, and written
once as a table with their place in it. Each line is checked by itself where it
lies; order, numbers and counts are checked across lines; the rolling hash,
which no two tasks can share, is one streaming pass that holds one batch at a
time. Of all broken rules the one of the first line is raised.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.errors import EnvelopeError
from engram.functions.jsons import canonical
from engram.schemas import AUDIT_EVENTS, MEMORIES
from engram.sources.jsonl import FORMAT, RECORDS, line_fault, manifest_of, trailer_fault

_LINE = "no bigint, kind string, brain_id string, at_ms bigint, name string, fault string, payload string"
_KINDS = {"memory": ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in MEMORIES.fields if f.name not in ("embedding", "profile_id")), "audit": ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in AUDIT_EVENTS.fields if f.name != "timeline_day")}


@dataclass
class StagedExport:
    """A checked export: ``lines`` has ``seq, kind`` and ``payload``, a record as JSON."""

    manifest: dict[str, Any]
    artifact_sha256: str
    lines: DataFrame
    path: str

    @property
    def export_id(self) -> str:
        return self.manifest["export_id"]

    def records(self, kind: str, after: int, upto: int) -> DataFrame:
        """Records of a kind with ``after < seq <= upto``, with their ``seq``."""
        own = self.lines.where((F.col("kind") == kind) & (F.col("seq") > after) & (F.col("seq") <= upto))
        return own.select("seq", F.from_json("payload", _KINDS[kind]).alias("p")).select("p.*", "seq")


def stage(spark: SparkSession, path: str, scratch: str, *, format_name: str = FORMAT) -> StagedExport:
    """Check the export at ``path`` (one file); its lines are kept under ``scratch``. The first violation raises ``EnvelopeError``."""
    scratch = f"{scratch.rstrip('/')}/{uuid.uuid4().hex}"
    text = spark.read.option("lineSep", "\n").text(path)
    meta = F.col("_metadata")
    raw = text.select("value", meta["file_path"].alias("file"), meta["file_size"].alias("size"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"))
    raw.write.parquet(f"{scratch}/raw")
    raw = spark.read.parquet(f"{scratch}/raw")
    # A row for each block of the file: a block is some megabytes.
    blocks = raw.groupBy("block").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.sum(F.octet_length("value") + 1).alias("bytes"), F.max("size").alias("size"), F.min("file").alias("file"), F.max("file").alias("other")).orderBy("block").collect()
    files = {f for b in blocks for f in (b["file"], b["other"])}
    if len(files) != 1:
        raise EnvelopeError(f"{path}: {len(files)} files with lines, one is needed")
    total = sum(b["n"] for b in blocks)
    if sum(b["bytes"] for b in blocks) != blocks[0]["size"]:
        raise EnvelopeError("file: must end with LF")
    shape = raw.agg(F.coalesce(F.bool_or(F.contains("value", F.lit("\r"))), F.lit(False)), F.bool_and(F.is_valid_utf8("value"))).first()
    if shape[0]:
        raise EnvelopeError("file: CR found, the format is LF-only")
    if not shape[1]:
        raise EnvelopeError("file: not UTF-8")
    offsets, n = [], 0
    for b in blocks:
        offsets.append((b["block"], n - b["first"]))
        n += b["n"]
    placed = raw.join(F.broadcast(spark.createDataFrame(offsets, "block bigint, _from bigint")), "block").select((F.col("at") + F.col("_from") + 1).alias("no"), "block", "value")
    ends = {r["no"]: r["value"] for r in placed.where(F.col("no").isin(1, total)).collect()}
    manifest = manifest_of(ends[1], format_name)
    number = manifest["memory_count"] + manifest["audit_count"]
    if total - 2 != number:
        raise EnvelopeError(f"file: {total - 2} data lines, the manifest has {number}")
    exported = manifest["exported_at_ms"]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for no, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                row, said = line_fault(line, exported)
                if not said and row["seq"] != no - 1:
                    said = f"numbers are not contiguous, {row['seq']} stands where {no - 1} belongs"
                if said:
                    out.append((no, None, None, None, None, said, None))
                    continue
                p, kind = row["payload"], row["kind"]
                key = RECORDS[kind][2](p)
                as_text = {"metadata": canonical(p["metadata"], ascii_only=True)} if kind == "memory" else {"detail_json": canonical(p["detail"], ascii_only=True)}
                out.append((no, kind, key[0], key[1] if kind == "audit" else 0, key[-1], None, canonical({k: v for k, v in p.items() if k != "detail"} | as_text)))
            cols = list(zip(*out, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["no", "kind", "brain_id", "at_ms", "name", "fault", "payload"])

    data = placed.where((F.col("no") > 1) & (F.col("no") < total))
    data.select("no", "value").mapInArrow(check, _LINE).write.parquet(f"{scratch}/lines")
    lines = spark.read.parquet(f"{scratch}/lines")
    faults = lines.where("fault is not null").select("no", "fault").unionByName(_out_of_order(lines))
    first = faults.orderBy("no").first()
    if first:
        raise EnvelopeError(f"line {first['no']}: {first['fault']}")
    counts = {r["kind"]: r["n"] for r in lines.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    if (counts.get("memory", 0), counts.get("audit", 0)) != (manifest["memory_count"], manifest["audit_count"]):
        raise EnvelopeError("file: the numbers of memories and events are not the manifest's")
    rolling, whole = _hashes(placed, total)
    if said := trailer_fault(ends[total], manifest, rolling):
        raise EnvelopeError(f"line {total}: {said}")
    return StagedExport(manifest, whole, lines.select((F.col("no") - 1).alias("seq"), "kind", "payload"), scratch)


def _out_of_order(lines: DataFrame) -> DataFrame:
    """``no, fault`` of lines that sort before the line above; memories come first.

    Lines are compared within stretches of some thousand, and each stretch's first
    one with the last one of the stretch before.
    """
    place = F.struct((F.col("kind") == "audit").alias("a"), F.col("brain_id").alias("b"), F.col("at_ms").alias("c"), F.col("name").alias("d"))
    keyed = lines.where("fault is null").select("no", place.alias("place"), F.floor(F.col("no") / 8192).alias("part"))
    before = F.lag("place").over(Window.partitionBy("part").orderBy("no"))
    within = keyed.withColumn("_before", before).where(F.col("_before") > F.col("place")).select("no")
    edges = keyed.groupBy("part").agg(F.min_by("place", "no").alias("low"), F.max_by("place", "no").alias("high"), F.min("no").alias("no"))
    last = edges.select((F.col("part") + 1).alias("part"), F.col("high").alias("_before"))
    return within.unionByName(edges.join(last, "part").where(F.col("_before") > F.col("low")).select("no")).select("no", F.lit("lines are not sorted, memories first").alias("fault"))


def _hashes(placed: DataFrame, total: int) -> tuple[str, str]:
    """Hashes of all lines but the last one, and of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = hashlib.sha256()
        before = None
        for b in batches:
            for no, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if no == total:
                    before = rolling.hexdigest()
                rolling.update(value.encode())
                rolling.update(b"\n")
        if before:
            yield pa.RecordBatch.from_pydict({"rolling": [before], "whole": [rolling.hexdigest()]})

    found = placed.select("no", "value").repartition(1).sortWithinPartitions("no").mapInArrow(run, "rolling string, whole string").first()
    return found["rolling"], found["whole"]
