"""Streams with bounded state: repeats, conflicts, expiry of state, restarts."""

import os

import pytest
from pyspark.sql import functions as F

from engram.streaming.ingest import ends, ingest, lifecycle_stream

from test_retrieval import DAY, NOW, memory, table


class Inbox:
    """A folder whose files are read one a batch, in the order in which they came."""

    def __init__(self, spark, tmp_path):
        self.spark, self.path, self.n = spark, tmp_path, 0

    def put(self, df):
        import os
        import time

        df.coalesce(1).write.parquet(f"{self.path}/in/{self.n:03}")
        self.schema = df.schema
        for f in os.listdir(f"{self.path}/in/{self.n:03}"):
            os.utime(f"{self.path}/in/{self.n:03}/{f}", (time.time() + self.n, time.time() + self.n))
        self.n += 1

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/in/*")

    def ingest(self, **kw):
        q = ingest(self.stream(), f"{self.path}/out", f"{self.path}/state", started_ms=NOW, **kw)
        q.awaitTermination()
        return q

    def written(self):
        return sorted((r["memory_id"], r["summary"]) for r in self.spark.read.parquet(f"{self.path}/out").collect())


def kept(q):
    """Rows of state after the last batch."""
    return sum(o.numRowsTotal for o in q.recentProgress[-1].stateOperators)


def test_repeats_are_written_once(spark, tmp_path):
    box = Inbox(spark, tmp_path)
    box.put(table(spark, memory("a"), memory("a"), memory("b"), memory("dead", expires=NOW)))
    box.put(table(spark, memory("b"), memory("c"), *(memory("hot") for _ in range(50))))
    box.ingest()
    assert [m for m, _ in box.written()] == ["a", "b", "c", "hot"]
    box.put(table(spark, memory("a"), memory("hot"), memory("d")))
    box.ingest()  # after a restart the state is there
    assert [m for m, _ in box.written()] == ["a", "b", "c", "d", "hot"]


@pytest.mark.parametrize("apart", [True, False])
def test_a_conflict_stops_the_stream(spark, tmp_path, apart):
    box = Inbox(spark, tmp_path)
    if apart:
        box.put(table(spark, memory("a", summary="one")))
        box.put(table(spark, memory("a", summary="two")))
    else:
        box.put(table(spark, memory("a", summary="one"), memory("a", summary="two")))
    with pytest.raises(Exception, match="conflict"):
        box.ingest()


def test_keys_are_forgotten_after_their_span(spark, tmp_path):
    """The cost of a batch does not grow: state holds the keys of one span only."""
    box = Inbox(spark, tmp_path)
    for i in range(6):
        rows = table(spark, *(memory(f"m{i}-{j}") for j in range(5)), memory("again"))
        box.put(rows.withColumn("arrives", F.lit(NOW + i * DAY)))
    q = box.ingest(keep_ms=2 * DAY, arrival=F.timestamp_millis(F.col("arrives")), late="0 seconds")
    assert kept(q) <= 5 * 3 + 1
    names = [m for m, _ in box.written()]
    assert sorted(set(names)) == sorted({"again", *(f"m{i}-{j}" for i in range(6) for j in range(5))})
    assert 1 < names.count("again") <= 3  # forgotten after two days, new then


def outcomes(spark, box, name):
    q = lifecycle_stream(box.stream(), late="0 seconds").writeStream.format("parquet").option("path", f"{box.path}/{name}").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{box.path}/s").start()
    q.awaitTermination()
    return q, {r["op_seq"]: r["outcome"] for r in spark.read.parquet(f"{box.path}/{name}").collect()}


def test_state_of_a_lifecycle_ends(spark, tmp_path):
    ddl = "brain_id string, memory_id string, op_seq long, op string, at_ms long, importance int"
    box = Inbox(spark, tmp_path)
    put = lambda *ops: box.put(spark.createDataFrame([("b", *o) for o in ops], ddl))
    put(("short", 1, "remember", NOW, 1), ("long", 2, "remember", NOW, 5), ("gone", 3, "remember", NOW, 3))
    put(("gone", 4, "hard_delete", NOW + 1, None), ("short", 5, "forget", NOW + 2, None))
    q, _ = outcomes(spark, box, "out")
    assert kept(q) >= 2
    put(("short", 6, "restore", NOW + DAY, None))  # within its grace
    put(("long", 7, "reinforce", NOW + 9 * DAY, None), ("short", 8, "forget", NOW + 9 * DAY, None))  # restored for seven days
    put(("short", 9, "reinforce", NOW + 10 * DAY, None))
    q, got = outcomes(spark, box, "out")
    assert got == {1: "applied", 2: "applied", 3: "applied", 4: "applied", 5: "applied", 6: "applied", 7: "applied", 8: "not_found", 9: "not_found"}
    put(("long", 10, "reinforce", NOW + 11 * DAY, None))
    q, got = outcomes(spark, box, "out")
    held = kept(q)
    put(("other", 11, "forget", NOW + 800 * DAY, None))
    put(("other", 12, "forget", NOW + 801 * DAY, None))
    q, got = outcomes(spark, box, "out")
    assert got[10] == "applied" and got[11] == got[12] == "not_found" and kept(q) < held


def test_ends():
    assert ends(None, 5) == 5 and ends(3, 5) == 3 + 30 * DAY and ends(3, 100 * DAY) == 100 * DAY


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no driver tables here")
def test_files_of_the_stream_with_repeats_grow_in_number_and_not_in_size(spark, tmp_path, monkeypatch):
    from engram.plans import catalog

    monkeypatch.setattr(catalog, "REPEAT_ROWS", 20, raising=False)
    monkeypatch.setattr(catalog, "_scratch", lambda spark, name: str(tmp_path))
    assert catalog.stream_repeats(spark, "/root/testdata/sf0.001").count() == catalog._mem(spark, "/root/testdata/sf0.001").where(F.col("expires_at_ms") > catalog.NOW).count()
    assert len(list((tmp_path / "in" / "a").glob("part-*"))) == 10
