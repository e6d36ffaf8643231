"""Scans, BM25, cosine search and fusion on small tables, against plain Python."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from engram.errors import ValidationError
from engram.functions.text import tokenize
from engram.operators import fusion, lexical, scan, search, vector
from engram.schemas import BM25_WEIGHTS, MEMORIES

NOW = 1_752_200_000_000
DAY = 86_400_000


def memory(name, *, brain="b", topic="t", catalog="note", summary="s", content="", created=NOW - DAY, expires=NOW + DAY, deleted=None, importance=3, v=(1.0, 0.0)):
    return (name, brain, "a", topic, catalog, summary, content, "2025-07-11", None, None, created, created, importance, expires, deleted, "{}", "p", 1, None if v is None else list(v))


def table(spark, *rows):
    return spark.createDataFrame(list(rows), MEMORIES)


def ask(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id string, brain_id string, text string, vector array<double>")


def bm25(rows, query):
    docs = {r[0]: [(t, w) for c, w in zip((3, 5, 6), BM25_WEIGHTS.values(), strict=True) for t in tokenize(r[c])] for r in rows}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    out = {}
    for name, toks in docs.items():
        s, hit = 0.0, False
        for term in dict.fromkeys(tokenize(query)):
            df = sum(any(t == term for t, _ in d) for d in docs.values())
            f = sum(w for t, w in toks if t == term)
            if f:
                hit = True
                idf = math.log((n - df + 0.5) / (df + 0.5))
                s -= (idf if idf > 0 else 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(toks) / avg))
        if hit:
            out[name] = s
    return out


def test_live_boundary_and_isolation(spark):
    m = table(spark, memory("live"), memory("edge", expires=NOW), memory("gone", deleted=NOW - 1), memory("other", brain="x"))
    assert [r["memory_id"] for r in scan.recent(m, brain_id="b", now_ms=NOW).collect()] == ["live"]
    for name, n in (("live", 1), ("edge", 0), ("gone", 0), ("other", 0), ("none", 0)):
        assert scan.get(m, name, brain_id="b", now_ms=NOW).count() == n


def test_recent_orders_and_limits(spark):
    m = table(spark, memory("b", created=5), memory("a", created=5), memory("c", created=9))
    assert [r["memory_id"] for r in scan.recent(m, brain_id="b", now_ms=NOW, limit=2).collect()] == ["c", "a"]
    for bad in (0, 101, True):
        with pytest.raises(ValidationError):
            scan.recent(m, brain_id="b", now_ms=NOW, limit=bad)


@pytest.mark.parametrize("bad", [{"topic": " "}, {"timeline_day": "2025-1-1"}, {"min_importance": 0}, {"min_importance": True}, {"since_ms": 2, "until_ms": 1}])
def test_filters_are_checked(bad):
    with pytest.raises(ValidationError):
        scan.Filters(**bad)


def test_bm25_equals_formula_with_global_statistics(spark):
    rows = [
        memory("a", summary="red fox", content="fox fox den"),
        memory("b", summary="blue fox", topic="fox"),
        memory("c", summary="green hen", content="a den of red hens"),
        memory("d", summary="red red", deleted=1),
        memory("e", brain="x", summary="fox"),
    ]
    got = lexical.lexical_branch(table(spark, *rows), ask(spark, ("q", "b", "Fox RED fox den", None)), scan.is_live(NOW)).collect()
    want = {k: v for k, v in bm25(rows, "Fox RED fox den").items() if k in "abc"}
    assert {r["memory_id"]: r["score"] for r in got} == pytest.approx(want, abs=1e-12)
    assert [r["memory_id"] for r in sorted(got, key=lambda r: r["rank"])] == sorted(want, key=lambda k: (want[k], k))


def test_dead_rows_do_not_starve_the_branch(spark):
    dead = [memory(f"d{i}", summary="fox fox", deleted=1) for i in range(5)]
    got = lexical.lexical_branch(table(spark, memory("live", summary="a fox here"), *dead), ask(spark, ("q", "b", "fox", None)), scan.is_live(NOW), limit=2)
    assert [r["memory_id"] for r in got.collect()] == ["live"]


def test_cosine_floor_ties_and_malformed(spark):
    at = lambda c: (c, math.sqrt(1 - c * c))
    rows = [memory("b", v=at(0.5)), memory("a", v=at(0.5)), memory("low", v=at(0.299999)), memory("on", v=at(0.3)), memory("nan", v=(math.nan, 1.0)), memory("zero", v=(0.0, 0.0)), memory("short", v=(1.0,)), memory("none", v=None)]
    got = vector.vector_branch(table(spark, *rows), ask(spark, ("q", "b", "", [1.0, 0.0])), scan.is_live(NOW)).orderBy("rank").collect()
    assert [r["memory_id"] for r in got] == ["a", "b", "on"] and got[2]["key"] == 300_000


def test_native_and_batched_cosines_agree(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [memory(f"m{i:03}", v=rng.normal(size=8).tolist()) for i in range(60)]
    q = rng.normal(size=8).tolist()
    m = table(spark, *rows)
    a = {r["memory_id"]: r["key"] for r in vector.cosine_keys(m, q).collect()}
    b = {r["memory_id"]: r["key"] for r in vector.vector_branch(m, ask(spark, ("q", "b", "", q)), F.lit(True), limit=100, floor=-10**7).collect()}
    assert a == b


def test_fusion_matches_lists(spark):
    lex, vec = [("a", 1), ("b", 2), ("c", 3), ("b", 9)], [("c", 1), ("d", 2), ("a", 3)]
    frame = lambda rows: spark.createDataFrame([("q", *r) for r in rows], "query_id string, memory_id string, rank int")
    got = [(r["memory_id"], r["score"]) for r in fusion.fuse(frame(lex), frame(vec)).orderBy("rank").collect()]
    assert got == fusion.fuse_lists(lex, vec)
    assert [n for n, _ in fusion.fuse_lists([("x", 1)], [("y", 1)])] == ["x", "y"]
    for bad in ({"top_k": 0}, {"k": 0}):
        with pytest.raises(ValidationError):
            fusion.fuse(frame(lex), frame(vec), **bad)
        with pytest.raises(ValidationError):
            fusion.fuse_lists(lex, vec, **bad)


def test_hybrid_search_many_queries(spark):
    m = table(spark, memory("text", summary="needle", v=(0.1, 0.995)), memory("near", summary="other", v=(0.9, 0.436)), memory("x", brain="x", summary="needle"))
    q = ask(spark, ("both", "b", "needle", [1.0, 0.0]), ("punct", "b", "?!", [1.0, 0.0]), ("words", "b", "needle", None))
    got = {}
    for r in search.search(m, q, now_ms=NOW).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["memory_id"])
    assert got == {"both": ["near", "text"], "punct": ["near"], "words": ["text"]}


def test_injection_is_only_text(spark):
    m = table(spark, memory("a", summary="or near"))
    q = ask(spark, ("q", "b", '" OR NEAR(x) AND * topic: \' ; DROP', None))
    assert search.search(m, q, now_ms=NOW).count() == 1


def test_empty_tables(spark):
    empty = spark.createDataFrame([], MEMORIES)
    assert search.search(empty, ask(spark, ("q", "b", "x", [1.0, 0.0])), now_ms=NOW).count() == 0
    none = spark.createDataFrame([], "query_id string, brain_id string, text string, vector array<double>")
    assert search.search(table(spark, memory("a")), none, now_ms=NOW).count() == 0
