"""JSON Lines exports: reading with full validation, writing, and tables of their records.

A file is manifest, memory lines, audit lines and trailer. Its rolling hash runs
over all lines in order, so one file is one task's work; many files are read in
parallel. The first broken rule raises.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.errors import EnvelopeError
from engram.functions.jsons import canonical, parse
from engram.schemas import AUDIT_ACTIONS, TTL_TOLERANCE_MS

#: The format's name, version, and the kind of each key's value. The name is an argument where a producer uses another.
FORMAT, FORMAT_VERSION, EXPIRY_MODE = "memory-jsonl", 1, "absolute_epoch_ms"
MANIFEST = {
    "kind": "any", "format": "any", "format_version": "any", "export_id": "any", "source_app_version": "any", "source_schema_version": "any", "source_commit": "any",
    "source_embedding_profile": "any", "exported_at_ms": "whole number", "expiry_mode": "any", "memory_count": "count", "audit_count": "count",
}
LINE = {"seq": "whole number", "kind": "any", "idempotency_key": "any", "payload": "object", "payload_sha256": "any"}
MEMORY = {
    "memory_id": "string", "brain_id": "string", "agent_id": "string", "topic": "string", "catalog": "string", "summary": "string", "content": "string", "timeline_day": "string",
    "period_start_ms": "whole number or null", "period_end_ms": "whole number or null", "created_at_ms": "whole number", "updated_at_ms": "whole number", "importance": "whole number",
    "expires_at_ms": "whole number", "deleted_at_ms": "whole number or null", "metadata": "object", "record_version": "whole number", "remaining_ttl_ms": "whole number",
}
AUDIT = {"event_id": "string", "brain_id": "string", "memory_id": "string", "agent_id": "string", "action": "string", "event_at_ms": "whole number", "detail": "object"}
TRAILER = {"kind": "any", "memory_count": "any", "audit_count": "any", "last_seq": "any", "rolling_sha256": "any"}

_DAY = re.compile(r"\d{4}-\d{2}-\d{2}")
_whole = lambda v: isinstance(v, int) and not isinstance(v, bool)
_KINDS = {
    "any": lambda v: True,
    "string": lambda v: isinstance(v, str),
    "object": lambda v: isinstance(v, dict),
    "whole number": _whole,
    "whole number or null": lambda v: v is None or _whole(v),
    "count": lambda v: _whole(v) and v >= 0,
}


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _is_uuid(v: Any) -> bool:
    try:
        return bool(uuid.UUID(str(v)))
    except ValueError:
        return False


#: What must hold of a record besides its keys and kinds; each has what is said when it does not.
MANIFEST_RULES = {
    "this is no manifest of the wanted format and version": lambda m, name: (m["kind"], m["format"], m["format_version"], m["expiry_mode"]) == ("manifest", name, FORMAT_VERSION, EXPIRY_MODE),
    "the export's id is no UUID": lambda m, name: _is_uuid(m["export_id"]),
}
MEMORY_RULES = {
    "the day is not written as year-month-day": lambda p, exported: bool(_DAY.fullmatch(p["timeline_day"])),
    "the period ends before it starts": lambda p, exported: None in (p["period_start_ms"], p["period_end_ms"]) or p["period_start_ms"] <= p["period_end_ms"],
    "there are five degrees of importance, from 1 on": lambda p, exported: 1 <= p["importance"] <= 5,
    "the time left is not that of the expiry": lambda p, exported: abs(p["remaining_ttl_ms"] - max(0, p["expires_at_ms"] - exported)) <= TTL_TOLERANCE_MS,
}
AUDIT_RULES = {"an action of this name is not known": lambda p, exported: p["action"] in AUDIT_ACTIONS}
RECORDS = {
    "memory": (MEMORY, MEMORY_RULES, lambda p: (p["brain_id"], p["memory_id"])),
    "audit": (AUDIT, AUDIT_RULES, lambda p: (p["brain_id"], p["event_at_ms"], p["event_id"])),
}
LINE_RULES = {
    "lines are of memories or of audit events": lambda r, exported: r["kind"] in RECORDS,
    "payload_sha256 mismatch": lambda r, exported: r["payload_sha256"] == _sha(canonical(r["payload"])),
}


def fault(row: dict, kinds: dict[str, str], rules: dict[str, Callable], *context: Any) -> str | None:
    """What is wrong with a record: its keys, a value's kind, or a rule; in this order."""
    if row.keys() != kinds.keys():
        return f"keys: extra={sorted(row.keys() - kinds.keys())}, missing={sorted(kinds.keys() - row.keys())}"
    wrong = next((k for k, kind in kinds.items() if not _KINDS[kind](row[k])), None)
    if wrong:
        return f"{wrong} is no {kinds[wrong]}"
    return next((said for said, holds in rules.items() if not holds(row, *context)), None)


def as_object(line: str) -> tuple[dict, str | None]:
    """A line's object, and what is wrong with its form."""
    try:
        value = parse(line)
    except ValueError as e:
        return {}, "non-finite number" if "non-finite" in str(e) else "no JSON"
    if not isinstance(value, dict):
        return {}, "no object"
    return value, None if canonical(value) == line else "not in canonical form"


def line_fault(line: str, exported: int) -> tuple[dict, str | None]:
    """A data line's object, and what is wrong with the line by itself."""
    row, said = as_object(line)
    said = said or fault(row, LINE, LINE_RULES, exported)
    if not said:
        kinds, rules, key = RECORDS[row["kind"]]
        p = row["payload"]
        said = fault(p, kinds, rules, exported)
        if not said and row["idempotency_key"] != f"{row['kind']}:{p['brain_id']}:{key(p)[-1]}":
            said = "the key that repeats are known by is not the record's"
    return row, said


def manifest_of(line: str, format_name: str = FORMAT) -> dict[str, Any]:
    row, said = as_object(line)
    if said := said or fault(row, MANIFEST, MANIFEST_RULES, format_name):
        raise EnvelopeError(f"line 1: {said}")
    return row


def trailer_fault(line: str, manifest: dict, rolling: str) -> str | None:
    """What is wrong with the last line, ``rolling`` being the hash of all others."""
    row, said = as_object(line)
    counts = manifest["memory_count"], manifest["audit_count"]
    rules = {
        "this is no trailer": lambda t: t["kind"] == "trailer",
        "its counts are not the manifest's": lambda t: (t["memory_count"], t["audit_count"], t["last_seq"]) == (*counts, sum(counts)),
        "rolling_sha256 mismatch": lambda t: t["rolling_sha256"] == rolling,
    }
    return said or fault(row, TRAILER, rules)


@dataclass
class Envelope:
    manifest: dict[str, Any]
    memories: list[dict[str, Any]] = field(default_factory=list)
    audits: list[dict[str, Any]] = field(default_factory=list)
    artifact_sha256: str = ""

    @property
    def export_id(self) -> str:
        return self.manifest["export_id"]


def parse_envelope(data: bytes, *, format_name: str = FORMAT) -> Envelope:
    """Validate a small file in memory; the first violation raises ``EnvelopeError``. Large ones are read by ``exports.stage``."""
    shape = {"file: CR found, the format is LF-only": b"\r" in data, "file: must end with LF": not data.endswith(b"\n")}
    if said := next((k for k, broken in shape.items() if broken), None):
        raise EnvelopeError(said)
    try:
        first, *lines = data.decode("utf-8")[:-1].split("\n")
    except UnicodeDecodeError as e:
        raise EnvelopeError(f"file: not UTF-8: {e}") from None
    out = Envelope(manifest_of(first, format_name), artifact_sha256=hashlib.sha256(data).hexdigest())
    number = out.manifest["memory_count"] + out.manifest["audit_count"]
    if len(lines) - 1 != number:
        raise EnvelopeError(f"file: {len(lines) - 1} data lines, the manifest has {number}")
    rows, before = {"memory": out.memories, "audit": out.audits}, None
    for seq, line in enumerate(lines[:-1], 1):
        row, said = line_fault(line, out.manifest["exported_at_ms"])
        if not said and row["seq"] != seq:
            said = f"numbers are not contiguous, {row['seq']} stands where {seq} belongs"
        if not said:
            place = (row["kind"] == "audit", RECORDS[row["kind"]][2](row["payload"]))
            if before is not None and place < before:
                said = "lines are not sorted, memories first"
            before = place
            rows[row["kind"]].append(row["payload"])
        if said:
            raise EnvelopeError(f"line {seq + 1}: {said}")
    if (len(out.memories), len(out.audits)) != (out.manifest["memory_count"], out.manifest["audit_count"]):
        raise EnvelopeError("file: the numbers of memories and events are not the manifest's")
    if said := trailer_fault(lines[-1], out.manifest, hashlib.sha256(data[: len(data) - len(lines[-1].encode()) - 1]).hexdigest()):
        raise EnvelopeError(f"line {len(lines) + 1}: {said}")
    return out


def build_envelope(memories: Iterable[dict], audits: Iterable[dict], *, export_id: str, exported_at_ms: int, format_name: str = FORMAT, **source: Any) -> bytes:
    """An export of payloads; ``remaining_ttl_ms`` is filled in."""
    mem = sorted(({**m, "remaining_ttl_ms": max(0, m["expires_at_ms"] - exported_at_ms)} for m in memories), key=lambda m: (m["brain_id"], m["memory_id"]))
    aud = sorted(audits, key=lambda a: (a["brain_id"], a["event_at_ms"], a["event_id"]))
    head = dict.fromkeys(MANIFEST, "") | {"source_schema_version": 1} | source
    head |= {"kind": "manifest", "format": format_name, "format_version": FORMAT_VERSION, "export_id": export_id, "exported_at_ms": exported_at_ms, "expiry_mode": EXPIRY_MODE}
    lines = [canonical(head | {"memory_count": len(mem), "audit_count": len(aud)})]
    for seq, (kind, p) in enumerate([*(("memory", m) for m in mem), *(("audit", a) for a in aud)], 1):
        key = f"{kind}:{p['brain_id']}:{p['memory_id' if kind == 'memory' else 'event_id']}"
        lines.append(canonical({"seq": seq, "kind": kind, "idempotency_key": key, "payload": p, "payload_sha256": _sha(canonical(p))}))
    body = "".join(x + "\n" for x in lines)
    trailer = {"kind": "trailer", "memory_count": len(mem), "audit_count": len(aud), "last_seq": len(mem) + len(aud), "rolling_sha256": _sha(body)}
    return (body + canonical(trailer) + "\n").encode()


_MEMORY_ROW = "memory_id string, brain_id string, agent_id string, topic string, catalog string, summary string, content string, timeline_day string, period_start_ms bigint, period_end_ms bigint, created_at_ms bigint, updated_at_ms bigint, importance int, expires_at_ms bigint, deleted_at_ms bigint, metadata string, record_version int, remaining_ttl_ms bigint"
_AUDIT_ROW = "event_id string, brain_id string, memory_id string, agent_id string, action string, event_at_ms bigint, detail_json string"


def read_exports(spark: SparkSession, path: str, *, format_name: str = FORMAT) -> tuple[DataFrame, DataFrame]:
    """(memories, audit events) of all exports under ``path``, with ``export_id`` and ``seq``.

    Files are read as a whole by Spark's reader, validated one a task, in parallel.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    kinds = "path string, export_id string, kind string, seq bigint, payload string"

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    e = parse_envelope(data, format_name=format_name)
                except EnvelopeError as x:
                    raise EnvelopeError(f"{name}: {x}") from None
                rows = [("memory", p) for p in e.memories] + [("audit", p) for p in e.audits]
                payload = [canonical({**p, **({"metadata": canonical(p["metadata"], ascii_only=True)} if k == "memory" else {"detail_json": canonical(p["detail"], ascii_only=True)})}) for k, p in rows]
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n, pa.string()), pa.array([e.export_id] * n, pa.string()), pa.array([k for k, _ in rows], pa.string()), pa.array(range(1, n + 1), pa.int64()), pa.array(payload, pa.string())],
                    names=["path", "export_id", "kind", "seq", "payload"],
                )

    lines = files.mapInArrow(run, kinds)
    take = lambda kind, row: lines.where(F.col("kind") == kind).select("export_id", "seq", F.from_json("payload", row).alias("p")).select("export_id", "seq", "p.*")
    return take("memory", _MEMORY_ROW), take("audit", _AUDIT_ROW)


def records_before(spark: SparkSession, path: str) -> DataFrame:
    """``export_id, before``: how many memories the files before an export's own hold, by name, in its folder.

    A row a file; only manifests are parsed, which canonical form lets begin with their first key.
    """
    lines = spark.read.text(path).where(F.col("value").startswith(f'{{"{min(MANIFEST)}":'))
    file = F.col("_metadata.file_path")
    heads = lines.select(F.regexp_extract(file, "^(.*)/", 1).alias("_folder"), file.alias("_file"), F.from_json("value", "kind string, export_id string, memory_count bigint").alias("m"))
    before = F.sum("memory_count").over(Window.partitionBy("_folder").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
    return heads.select("_folder", "_file", "m.*").where("kind = 'manifest'").select("export_id", F.coalesce(before, F.lit(0)).alias("before"))


def write_exports(memories: DataFrame, path: str, *, exported_at_ms: int, format_name: str = FORMAT, records_a_file: int = 10_000) -> None:
    """Exports of ``memories`` under ``path``, one folder a brain, of some ``records_a_file`` records each.

    Files are made in parallel, one a task at a time: a brain's rows are dealt to
    files by ranges of their ids, so its records are in order from file to file.
    """
    names = [k for k in sorted(MEMORY) if k != "remaining_ttl_ms"]
    rows = memories.select("brain_id", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("row"), "memory_id")
    sizes = {r["brain_id"]: r["n"] for r in memories.groupBy("brain_id").agg(F.count("*").alias("n")).collect()}  # a row a brain

    def run(batches):
        import pyarrow as pa

        held = [json.loads(x) for b in batches for x in b.column(0).to_pylist()]
        if held:
            for p in held:
                p["metadata"] = parse(p["metadata"])
            data = build_envelope(held, [], export_id=str(uuid.uuid4()), exported_at_ms=exported_at_ms, format_name=format_name)
            yield pa.RecordBatch.from_pydict({"value": data.decode().split("\n")[:-1]})

    for i, (brain, n) in enumerate(sorted(sizes.items())):
        own = rows.where(F.col("brain_id") == brain).repartitionByRange(-(-n // records_a_file), "memory_id")
        own.select("row").mapInArrow(run, "value string").write.text(f"{path}/{i:05}")
