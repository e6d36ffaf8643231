"""Writers that compete or die, keyed reads, the kept index, and answers as JSON."""

import json
import threading
import time

import pytest

from engram.errors import BusyError, ValidationError
from engram.operators import constraints
from engram.service import MemoryService
from engram.sources.store import Store

from test_retrieval import DAY, NOW, memory, table


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "store")


def service(spark, path, **kw):
    return MemoryService(Store(spark, path), brain_id="b", clock=lambda: NOW, **kw)


def test_a_dead_writers_lock_is_taken_over(spark, path):
    store = Store(spark, path)
    lock = f"{path}/_LOCK"
    with open(lock, "w") as f:
        json.dump({"owner": "dead", "until": time.time() + 60}, f)
    with pytest.raises(BusyError):
        store.commit()
    with open(lock, "w") as f:
        json.dump({"owner": "dead", "until": time.time() - 1}, f)
    store.append_memories(table(spark, memory("a")))
    assert store.memories().count() == 1


def test_a_writer_that_lost_its_lock_cannot_commit(spark, path):
    store = Store(spark, path)
    with pytest.raises(BusyError), store.transaction():
        with open(f"{path}/_LOCK", "w") as f:
            json.dump({"owner": "other", "until": time.time() + 60}, f)
        store._commit(None, {"memories": table(spark, memory("a"))})
    with open(f"{path}/_LOCK") as f:
        assert json.load(f)["owner"] == "other"
    assert Store(spark, path, read_only=True).memories().count() == 0


def test_two_writers_apply_a_change_once(spark, path):
    services = [service(spark, path) for _ in range(2)]
    name = services[0].remember("t", "a fox", agent_id="a")["memory_id"]
    said = []

    def forget(s):
        for _ in range(40):
            try:
                said.append(s.forget(name, agent_id="a")["ok"])
                return
            except BusyError:
                time.sleep(0.2)

    threads = [threading.Thread(target=forget, args=(s,)) for s in services]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(said) == [False, True]
    assert [r["action"] for r in services[0].audit()].count("forget") == 1


def test_index_is_kept_with_every_row(spark, path):
    """What comes is found and what goes is not, from the index alone; forgetting leaves it as it is."""
    s = service(spark, path)
    name = s.remember("den", "red fox", agent_id="a")["memory_id"]
    assert s.store.index() is not None and [r["memory_id"] for r in s.search("fox")] == [name] and s.health()["indexed"]
    s.forget(name, agent_id="a")
    before = s.store.index().segments
    assert s.search("fox") == []
    s.hard_delete(name, agent_id="a")
    assert s.store.index().segments != before and s.store.index().counts() == (0, 0)
    s.remember("den", "blue fox", agent_id="a")
    assert len(s.search("fox")) == 1
    parity(s)
    s.store.reindex()
    assert len(s.store.index().segments) == 1 and len(s.search("fox")) == 1
    parity(s)


def parity(s):
    assert constraints.index_parity(s.store.memories(), s.store.index().postings()).count() == 0


def test_retention_of_audit(spark, path):
    now = [NOW]
    s = MemoryService(Store(spark, path), brain_id="b", clock=lambda: now[0])
    s.remember("t", "one", agent_id="a")
    now[0] += 91 * DAY
    s.remember("t", "two", agent_id="a")
    assert s.purge_retained() == 1 and s.purge_retained() == 0
    assert s.store.table("audit").count() == 1 and s.store.memories().count() == 2


def test_answers(spark, path):
    s = service(spark, path, tz="Asia/Ho_Chi_Minh")
    name = json.loads(s.respond("remember", topic="t", summary="a fox", agent_id="a"))["memory_id"]
    found = json.loads(s.respond("recent"))
    assert found["count"] == 1 and found["results"][0]["memory_id"] == name
    got = json.loads(s.respond("get", memory_id=name))
    assert got["found"] and got["created_at"].endswith("+07:00")
    assert json.loads(s.respond("search", query=" "))["error"] == "ValidationError"
    assert s.current_day() == "2025-07-11"
    with pytest.raises(ValidationError):
        s.respond("purge_expired")
