"""Lifecycle transitions, purges, constraints and metrics."""

import random

import pytest
from pyspark.sql import functions as F

from engram.errors import ProfileMismatchError
from engram.operators import constraints, lifecycle, metrics
from engram.schemas import DAY_MS, PROFILES
from engram.streaming.ingest import step

from test_retrieval import NOW, memory, table


def test_fold_equals_one_by_one(spark):
    rng = random.Random(5)
    rows = [memory(f"m{i}", importance=1 + i % 5, expires=NOW + rng.randint(-2, 40) * DAY_MS, deleted=rng.choice([None, None, NOW - 31 * DAY_MS, NOW - DAY_MS])) for i in range(12)]
    ops = [(i, "b", f"m{rng.randrange(14)}", rng.choice(lifecycle.OPERATIONS[:3] * 4 + ("hard_delete",)), NOW + i * DAY_MS) for i in range(200)]
    got = {r["memory_id"]: r for r in lifecycle.fold(table(spark, *rows), spark.createDataFrame(ops, "op_seq long, brain_id string, memory_id string, op string, at_ms long")).collect()}
    state = {r[0]: (True, r[12], r[14], r[13]) for r in rows}
    log = {}
    for seq, _, name, op, at in ops:
        state[name], done = step(state.get(name, (False, None, None, None)), op, at, None)
        log.setdefault(name, []).append((seq, op, "applied" if done else "not_found"))
    for name, r in got.items():
        assert [tuple(o) for o in r["outcomes"]] == log[name]
        known, _, deleted, expires = state[name]
        assert r["removed"] == (r["known"] and not known)
        if known:
            assert (r["deleted_at_ms"], r["expires_at_ms"]) == (deleted, expires)


def test_boundaries(spark):
    grace = 30 * DAY_MS
    m = table(spark, memory("edge", deleted=NOW - grace), memory("in", deleted=NOW - grace + 1), memory("soon", expires=NOW + 5), memory("dead", expires=NOW))
    out = lambda op: {r["memory_id"]: r for r in lifecycle.apply_one(m, op, F.lit(True), now_ms=NOW).collect()}
    assert [out("restore")[k]["outcome"] for k in ("edge", "in")] == ["not_found", "applied"]
    assert out("forget")["soon"]["expires_at_ms"] == NOW + 5
    assert out("reinforce")["dead"]["outcome"] == "not_found"
    assert all(r["outcome"] == "applied" and r["removed"] for r in out("hard_delete").values())


def test_purge_is_bounded_and_ordered(spark):
    m = table(spark, *(memory(f"m{i}", expires=NOW - i) for i in range(5)), memory("stays"))
    kept, gone = lifecycle.purge_expired(m, now_ms=NOW, max_rows=2)
    assert sorted(r["memory_id"] for r in gone.collect()) == ["m3", "m4"] and kept.count() == 4


def test_constraints(spark):
    m = table(spark, memory("ok"), memory("bad", summary=" \t", importance=7))
    good, bad = constraints.validate(m, constraints.memory_rules(2))
    assert [r["memory_id"] for r in good.collect()] == ["ok"]
    assert bad.first()["violations"] == ["summary_filled", "importance_range"]
    with pytest.raises(Exception, match="summary_filled"):
        constraints.fail_fast(m, constraints.memory_rules()).collect()
    assert constraints.fail_fast(good, constraints.memory_rules()).count() == 1


def test_profiles(spark):
    empty = spark.createDataFrame([], PROFILES)
    assert constraints.register_profile(empty, {"profile_id": "p"}) == "new"
    one = spark.createDataFrame([("p", "1", 2, 8)], PROFILES)
    assert constraints.register_profile(one, {"profile_id": "p", "dimension": 8}) == "same"
    with pytest.raises(ProfileMismatchError):
        constraints.register_profile(one, {"profile_id": "p", "dimension": 9})


def test_metrics_by_hand(spark):
    ranking = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query_id string, doc_id string, rank int")
    judged = spark.createDataFrame([("q", "b", 2), ("q", "c", 1), ("q", "z", 1), ("q", "a", 0)], "query_id string, doc_id string, grade int")
    import math

    r = metrics.quality(ranking, judged).first()
    dcg = 2 / math.log2(3) + 1 / math.log2(4)
    idcg = 2 / math.log2(2) + 1 / math.log2(3) + 1 / math.log2(4)
    assert (r["recall"], r["mrr"]) == (pytest.approx(2 / 3), 0.5) and r["ndcg"] == pytest.approx(dcg / idcg)
