"""Mixing, packing, neighbours and the pipeline."""

import math
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.llm.mixing import mix_sources
from engram.llm.neighbours import Settings, brute_force, nearest_neighbours
from engram.llm.packing import Costs, best_fit, pack_documents


def test_mixing_reaches_targets(spark):
    docs = spark.range(6000).selectExpr("id doc_id", "repeat('x', 100) text", "'en' lang", "case when id % 3 = 0 then 'hot' when id = 1 then null else concat('s', id % 2) end source", "100L n_chars")
    out = mix_sources(docs, {"hot": 1.0, "s0": 3.0, "s1": 1.0, None: 0.0}, epochs=2.0)
    n = Counter(r["source"] for r in out.collect())
    assert None not in n
    for s, w in (("hot", 0.2), ("s0", 0.6), ("s1", 0.2)):
        assert n[s] / 12_000 == pytest.approx(w, abs=0.02)
    again = mix_sources(docs.repartition(3), {"hot": 1.0, "s0": 3.0, "s1": 1.0, None: 0.0}, epochs=2.0)
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))


def test_mixing_inverts_poisson_at_large_rates(spark):
    docs = spark.range(400).selectExpr("id doc_id", "'abc' text", "'s' source")
    n = Counter(r["doc_id"] for r in mix_sources(docs, {"s": 1.0}, epochs=40.0).collect())
    counts = [n.get(i, 0) for i in range(400)]
    assert np.mean(counts) == pytest.approx(40, abs=1.2) and np.var(counts) == pytest.approx(40, rel=0.3)


def test_mixing_edges(docs_of):
    docs = docs_of([(1, None), (2, ""), (None, "abc"), (3, "abc"), (3, "abc")]).withColumn("copy", F.lit("mine"))
    out = mix_sources(docs, epochs=3.0)
    assert "_copy" in out.columns and len({r["_copy"] for r in out.where("doc_id = 3").collect()}) * 2 == out.where("doc_id = 3").count()
    assert mix_sources(docs.limit(0)).count() == 0
    assert mix_sources(docs_of([None, ""])).count() >= 0


def test_best_fit_holds_and_downsizes():
    rng = np.random.default_rng(0)
    costs = Costs((512, 1024, 2048, 4096))
    sizes = np.minimum(rng.lognormal(5.5, 1.2, 5000).astype(np.int64) + 1, 4096)
    bins, offsets, caps = best_fit(sizes, costs)
    used = np.bincount(bins, sizes)
    assert (used <= caps).all() and set(caps) <= set(costs.lengths)
    assert all(c == costs.downsized(int(u)) for u, c in zip(used, caps, strict=True))
    assert sizes.sum() / caps.sum() > 0.97
    assert len(best_fit(np.zeros(0, np.int64), costs)[2]) == 0
    with pytest.raises(ValueError):
        Costs(())


def test_packing_round_trip(docs_of):
    rng = np.random.default_rng(1)
    texts = [None, "", " \n ", "w " * 10_000] + ["w\n" * int(n) for n in rng.integers(1, 900, 200)]
    rows = pack_documents(docs_of(texts), block=64).collect()
    n = Counter()
    for r in rows:
        n[r["doc_id"]] += r["n_tokens"]
    assert n == Counter({i: len((t or "").split()) for i, t in enumerate(texts)})
    assert [r["bin_id"] for r in rows if r["n_tokens"] == 0] == [None] * 3
    bins = {}
    for r in rows:
        if r["bin_id"] is not None:
            bins.setdefault(r["bin_id"], []).append(r)
    for own in bins.values():
        own.sort(key=lambda r: r["bin_offset"])
        assert [r["bin_offset"] for r in own] == [sum(x["n_tokens"] for x in own[:i]) for i in range(len(own))]
        assert sum(r["n_tokens"] for r in own) <= own[0]["capacity"] and len({r["capacity"] for r in own}) == 1
    assert pack_documents(docs_of([]).limit(0)).count() == 0
    with pytest.raises(ValueError):
        pack_documents(docs_of(["a"]), keep=("n_tokens",))


def search(df, k=10, **kw):
    got = {}
    for r in nearest_neighbours(df, F.col("vec_id") % 100 == 0, k=k, **kw).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return got


def test_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(40, 16))[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 0.5).astype(np.float32).astype(np.float64)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    ids = np.arange(4000)
    want = brute_force(ids, x, ids[ids % 100 == 0])
    got = search(df, settings=Settings(sample=2000, part=64))
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in w}) / 10 for q, w in want.items()])
    assert recall >= 0.9
    for q, rows in got.items():
        assert all(s == pytest.approx(math.dist(x[q], x[i]), rel=1e-12) for i, s in rows) and q not in {i for i, _ in rows}


def test_neighbours_edges(spark):
    rows = [(i, [1.0, 0.0]) for i in range(0, 500)] + [(1000, [0.0, 0.0]), (1001, None), (1002, [math.nan, 1.0]), (1003, [1.0]), (1100, [3.0, 0.0]), (1100, [3.0, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = search(df)
    assert set(got) == {0, 100, 200, 300, 400, 1100}
    assert [i for i, _ in got[0]] == list(range(1, 11)) and [i for i, _ in got[100]] == list(range(10))
    assert [s for _, s in got[1100]] == [2.0] * 10
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert search(few) == {0: [(1, 1.0)]}
    assert search(df.limit(0)) == {}


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")
def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    whole = docs
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, docs, DATA)
        assert after.columns == whole.columns, name
        docs = after
    packed = p.run(spark, DATA)
    tokens = Counter()
    for r in packed.collect():
        tokens[r["doc_id"]] += r["n_tokens"]
    texts = Counter()
    for r in docs.collect():
        texts[r["doc_id"]] += len(r["text"].split())
    assert tokens == texts


def test_packing_numbers_many_rows_without_an_id(spark):
    """They are one id's texts: each has its own numbers, one for each copy, and none is missing."""
    rows = [(None, f"text {i % 900}") for i in range(1200)] + [(1, "a b"), (1, "c d"), (1, "c d"), (2, "e")]
    found = pack_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    copies = sorted(r["copy"] for r in found if r["doc_id"] is None)
    assert copies == list(range(1, 1201))
    assert sorted(r["copy"] for r in found if r["doc_id"] == 1) == [1, 2, 3]
