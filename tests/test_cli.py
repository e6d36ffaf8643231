"""Settings, command line and doctor."""

import uuid

import pytest

from engram import cli, doctor
from engram.config import ConfigError, Settings, flag
from engram.functions.embedding import HashingEmbedder
from engram.service import MemoryService
from engram.sources.jsonl import build_envelope
from engram.sources.store import Store

from test_retrieval import NOW
from test_store import payload


def test_settings():
    s = Settings.of({"BRAIN_ID": " b ", "BRAIN_DATA_DIR": "/x/"})
    assert (s.brain_id, s.tz, s.store) == ("b", "UTC", "/x/store")
    for bad in ({"BRAIN_ID": "a:b"}, {"TIMELINE_TIMEZONE": "Nowhere/At all"}):
        with pytest.raises(ConfigError, match=next(iter(bad))):
            Settings.of(bad)
    assert [flag(x) for x in ("1", "TRUE", " on ", "no", "")] == [True, True, True, False, False]


@pytest.fixture
def run(spark, tmp_path, capsys):
    env = {"BRAIN_ID": "b", "BRAIN_DATA_DIR": str(tmp_path)}

    def call(*argv, **more):
        code = cli.main(list(argv), spark=spark, env=env | more, now_ms=lambda: NOW)
        return code, capsys.readouterr()

    return call


def test_recent_and_admin(spark, tmp_path, run):
    assert run("recent")[0] == cli.DONE
    s = MemoryService(Store(spark, f"{tmp_path}/store"), brain_id="b", clock=lambda: NOW)
    name = s.remember("fox-den", "red " * 60, agent_id="a", catalog="note")["memory_id"]
    code, said = run("recent", "--limit", "5")
    assert code == cli.DONE and name in said.out and "importance=3" in said.out and said.out.rstrip().endswith("...")
    code, said = run("admin", "restore", name)
    assert code == cli.FAILED and "not_found" in said.err
    s.forget(name, agent_id="a")
    code, said = run("admin", "restore", name)
    assert code == cli.DONE and "expires" in said.out
    assert run("admin", "hard-delete", name)[0] == cli.DONE and run("admin", "hard-delete", name)[0] == cli.FAILED
    for wrong in (["recent", "--limit", "0"], ["recent", "--limit", "x"], ["admin"], []):
        with pytest.raises(SystemExit) as e:
            run(*wrong)
        assert e.value.code == 2
    assert run("recent", BRAIN_ID="a:b")[0] == cli.MISCONFIGURED


def test_import_and_doctor(spark, tmp_path, run):
    (tmp_path / "x.jsonl").write_bytes(build_envelope([payload(0)], [], export_id=str(uuid.UUID(int=7)), exported_at_ms=NOW))
    assert [i.state for i in doctor.examine(spark, Settings.of({"BRAIN_DATA_DIR": str(tmp_path)}), HashingEmbedder())] == ["ok"] * 4 + ["warn", "ok"]
    code, said = run("import-jsonl", str(tmp_path / "x.jsonl"))
    assert code == cli.DONE and "imported=1" in said.out
    assert "noop" in run("import-jsonl", str(tmp_path / "x.jsonl"))[1].out
    (tmp_path / "y.jsonl").write_bytes(b"{}\n{}\n")
    code, said = run("import-jsonl", str(tmp_path / "y.jsonl"))
    assert code == cli.FAILED and said.err
    code, said = run("doctor")
    assert code == cli.DONE and [line.split()[1] for line in said.out.splitlines()] == ["platform:", "paths:", "package:", "model:", "database:", "probe:"]
