"""Exports, store, importer, service and streams."""

import json
import os
import uuid

import pytest

from engram.errors import BusyError, DuplicateKeyError, EnvelopeError, ImportConflictError, StoreError, ValidationError
from engram.functions.jsons import canonical
from engram.service import MemoryService
from engram.sources.importer import Importer
from engram.sources.jsonl import build_envelope, parse_envelope, read_exports
from engram.sources.store import Store
from engram.streaming.ingest import ingest, lifecycle_stream

from test_retrieval import DAY, NOW, memory, table


def payload(i, **kw):
    return {
        "memory_id": f"m{i}", "brain_id": "b", "agent_id": "a", "topic": "t", "catalog": "note", "summary": f"sum {i}", "content": "", "timeline_day": "2025-07-11",
        "period_start_ms": None, "period_end_ms": None, "created_at_ms": NOW - DAY, "updated_at_ms": NOW - DAY, "importance": 3, "expires_at_ms": NOW + DAY, "deleted_at_ms": None, "metadata": {"k": "é"}, "record_version": 1,
    } | kw


def event(i):
    return {"event_id": f"e{i}", "brain_id": "b", "memory_id": "m0", "agent_id": "a", "action": "remember", "event_at_ms": NOW + i, "detail": {"importance": 3}}


def export(n=7, m=3, **kw):
    return build_envelope([payload(i, **kw) for i in range(n)], [event(i) for i in range(m)], export_id=str(uuid.UUID(int=7)), exported_at_ms=NOW)


def edit(data, line, change):
    lines = data.decode().split("\n")
    row = json.loads(lines[line])
    change(row)
    lines[line] = canonical(row)
    return "\n".join(lines).encode()


@pytest.mark.parametrize(
    "broken,said",
    [
        (lambda d: d.replace(b"\n", b"\r\n"), "LF-only"),
        (lambda d: d[:-1], "end with LF"),
        (lambda d: edit(d, 0, lambda r: r.pop("expiry_mode")), "missing="),
        (lambda d: edit(d, 1, lambda r: r.update(payload_sha256="0")), "payload_sha256 mismatch"),
        (lambda d: edit(d, 2, lambda r: r.update(seq=9)), "contiguous"),
        (lambda d: edit(d, -2, lambda r: r.update(rolling_sha256="0")), "rolling_sha256 mismatch"),
        (lambda d: d.replace(b'"importance":3', b'"importance":NaN', 1), "non-finite"),
        (lambda d: edit(d, 1, lambda r: r["payload"].update(embedding="x")), "payload_sha256"),
    ],
)
def test_broken_exports(broken, said):
    with pytest.raises(EnvelopeError, match=said):
        parse_envelope(broken(export()))


def test_unsorted_and_ttl():
    good = export(2, 0)
    lines = good.decode().split("\n")
    lines[1], lines[2] = lines[2].replace('"seq":2', '"seq":1'), lines[1].replace('"seq":1', '"seq":2')
    with pytest.raises(EnvelopeError, match="not sorted|rolling"):
        parse_envelope("\n".join(lines).encode())
    assert len(parse_envelope(good).memories) == 2


def test_exports_as_tables(spark, tmp_path):
    (tmp_path / "one.jsonl").write_bytes(export())
    mem, aud = read_exports(spark, str(tmp_path / "*.jsonl"))
    assert mem.count() == 7 and aud.count() == 3 and mem.first()["metadata"] == '{"k":"\\u00e9"}'


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no driver tables here")
def test_a_brain_of_several_files_is_numbered_from_file_to_file(spark, monkeypatch):
    from functools import partial

    from engram.plans import catalog

    monkeypatch.setattr(catalog.jsonl, "write_exports", partial(catalog.jsonl.write_exports, records_a_file=9))
    brains = {}
    for r in catalog.line_sortedness(spark, "/root/testdata/sf0.001").collect():
        brains.setdefault(r["brain_id"], []).append((r["memory_id"], r["seq"]))
    assert max(map(len, brains.values())) > 27
    assert all([seq for _, seq in sorted(own)] == list(range(1, len(own) + 1)) for own in brains.values())


@pytest.mark.parametrize("stop", [3, 6, 9])
def test_import_resumes_to_the_same_state(spark, tmp_path, stop):
    (tmp_path / "x.jsonl").write_bytes(export())
    store = Store(spark, str(tmp_path / "store"))

    def bomb(done):
        if done == stop:
            raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        Importer(store, batch=3, after_batch=bomb).import_file(str(tmp_path / "x.jsonl"), now_ms=NOW)
    report = Importer(store, batch=3).import_file(str(tmp_path / "x.jsonl"), now_ms=NOW + 5)
    assert (report.status, report.imported, report.skipped) == ("completed", 10, 0)
    assert store.memories().count() == 7 and store.table("audit").count() == 3
    assert Importer(store).import_file(str(tmp_path / "x.jsonl"), now_ms=NOW).status == "noop"


def test_import_conflict_and_expiry(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    (tmp_path / "x.jsonl").write_bytes(export(2, 0))
    Importer(store).import_file(str(tmp_path / "x.jsonl"), now_ms=NOW)
    other = build_envelope([payload(0, summary="changed")], [], export_id=str(uuid.UUID(int=8)), exported_at_ms=NOW)
    (tmp_path / "y.jsonl").write_bytes(other)
    with pytest.raises(ImportConflictError):
        Importer(store).import_file(str(tmp_path / "y.jsonl"), now_ms=NOW)
    late = build_envelope([payload(5, expires_at_ms=NOW)], [], export_id=str(uuid.UUID(int=9)), exported_at_ms=NOW)
    (tmp_path / "z.jsonl").write_bytes(late)
    report = Importer(store).import_file(str(tmp_path / "z.jsonl"), now_ms=NOW)
    assert (report.imported, report.skipped) == (0, 1)


def test_store_rules(spark, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(StoreError):
        Store(spark, path, read_only=True)
    store = Store(spark, path)
    store.append_memories(table(spark, memory("a")))
    with pytest.raises(DuplicateKeyError):
        store.append_memories(table(spark, memory("a")))
    with pytest.raises(ValidationError):
        store.append_memories(table(spark, memory("b", importance=9)))
    with pytest.raises(StoreError):
        Store(spark, path, read_only=True).append_memories(table(spark, memory("c")))
    (tmp_path / "store" / "_LOCK").touch()
    with pytest.raises(BusyError):
        store.commit()
    (tmp_path / "store" / "_LOCK").unlink()
    store.compact()
    assert [r["memory_id"] for r in store.memories().collect()] == ["a"]


def test_service_session(spark, tmp_path):
    now = [NOW]
    make = lambda: MemoryService(Store(spark, str(tmp_path / "store")), brain_id="b", clock=lambda: now[0])
    s = make()
    name = s.remember("fox-den", "red fox seen", agent_id="a", content="long", metadata={"x": 1})["memory_id"]
    assert [r["memory_id"] for r in s.search("fox")] == [name]
    assert s.get(name)["metadata"] == {"x": 1} and s.get("nope") == {"found": False}
    now[0] += 1000
    assert s.forget(name, agent_id="a")["ok"] and s.recent() == []
    assert make().restore(name, agent_id="a")["ok"] and len(s.today()) == 1
    assert s.reinforce("nope", agent_id="a") == {"ok": False, "reason": "not_found"}
    assert {r["action"] for r in s.audit()} == {"remember", "forget", "restore"}
    assert s.health(deep=True)["status"] == "ok"
    now[0] += 100 * DAY
    assert s.purge_expired() == 1 and s.hard_delete(name, agent_id="a")["ok"] is False
    with pytest.raises(ValidationError):
        s.search("w " * 200)
    with pytest.raises(ValidationError):
        MemoryService(Store(spark, str(tmp_path / "store")), brain_id="a:b", clock=lambda: NOW)


def test_stream_ingest_is_once_only(spark, tmp_path):
    rows = table(spark, memory("a"), memory("b"), memory("late", expires=NOW))
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = lambda: ingest(source(), str(tmp_path / "out"), str(tmp_path / "state"), started_ms=NOW).awaitTermination()
    run()
    table(spark, memory("a"), memory("c")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert sorted(r["memory_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_lifecycle_stream(spark, tmp_path):
    ops = [("b", "m", 1, "remember", NOW, 1), ("b", "m", 2, "forget", NOW + 1, None), ("b", "m", 3, "restore", NOW + 2, None), ("b", "n", 4, "forget", NOW, None)]
    spark.createDataFrame(ops, "brain_id string, memory_id string, op_seq long, op string, at_ms long, importance int").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = lifecycle_stream(source).writeStream.format("memory").queryName("outcomes").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "s")).start()
    q.awaitTermination()
    got = {r["op_seq"]: r["outcome"] for r in spark.table("outcomes").collect()}
    assert got == {1: "applied", 2: "applied", 3: "applied", 4: "not_found"}


@pytest.mark.parametrize("split", [None, "300"])
def test_large_exports_are_read_by_many_tasks(spark, tmp_path, split):
    from engram.sources.exports import stage

    many = build_envelope([payload(i) | {"memory_id": f"m{i:05}"} for i in range(300)], [event(i) | {"event_id": f"e{i:05}"} for i in range(50)], export_id=str(uuid.UUID(int=7)), exported_at_ms=NOW)
    (tmp_path / "x.jsonl").write_bytes(many)
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(len(many) // 7))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = stage(spark, str(tmp_path / "x.jsonl"), str(tmp_path / "scratch"))
        if split:
            assert spark.read.text(str(tmp_path / "x.jsonl")).rdd.getNumPartitions() >= 7
        env = parse_envelope(many)
        assert found.artifact_sha256 == env.artifact_sha256 and found.manifest == env.manifest
        rows = found.records("memory", 0, 350).orderBy("seq").collect()
        assert [r["memory_id"] for r in rows] == [m["memory_id"] for m in env.memories] and [r["seq"] for r in rows] == list(range(1, 301))
        assert found.records("audit", 310, 320).count() == 10
        for change, said in [
            (lambda d: edit(d, 200, lambda r: r.update(seq=9)), "line 201: .*contiguous"),
            (lambda d: edit(edit(d, 250, lambda r: r.update(seq=9)), 120, lambda r: r["payload"].update(embedding="x")), "line 121: payload_sha256"),
            (lambda d: edit(d, -2, lambda r: r.update(rolling_sha256="0")), "line 352: rolling_sha256 mismatch"),
            (lambda d: d.replace(b"\n", b"\r\n"), "LF-only"),
            (lambda d: d[:-1], "end with LF"),
            (lambda d: d.replace("é".encode(), b"\xff\xfe", 1), "UTF-8"),
            (swapped, "not sorted"),
            (lambda d: b"\n".join(d.split(b"\n")[:5] + d.split(b"\n")[6:]), "data lines"),
        ]:
            (tmp_path / "bad.jsonl").write_bytes(change(many))
            with pytest.raises(EnvelopeError, match=said):
                stage(spark, str(tmp_path / "bad.jsonl"), str(tmp_path / "scratch"))
    finally:
        for c in ("maxPartitionBytes", "openCostInBytes"):
            spark.conf.unset(f"spark.sql.files.{c}")


def swapped(data):
    """Two neighbouring records in the wrong order, each line right by itself."""
    lines = data.decode().split("\n")
    a, b = json.loads(lines[100]), json.loads(lines[101])
    a["seq"], b["seq"] = b["seq"], a["seq"]
    lines[100], lines[101] = canonical(b), canonical(a)
    return "\n".join(lines).encode()
