"""The registered queries: SQL where there is some, else brute force on whole small tables."""

import os
import re
from collections import Counter

import numpy as np
import pytest

from engram.llm.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")


@pytest.fixture(scope="module")
def texts(spark):
    return dict(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    got = queries()[name](spark, DATA)
    want = c.sql(oracle_sql()[name])
    pick = lambda cols, rows: Counter(tuple(str(r[cols.index(x)]) for x in sorted(cols)) for r in rows)
    assert pick(got.columns, got.collect()) == pick(want.columns, want.fetchall())


def test_jaccard(spark, texts):
    from engram.llm.jaccard import brute_force

    rows = queries()["op4_jaccard"](spark, DATA).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute_force(texts, 3, 90)


def test_passages(spark, texts):
    seen = {}
    for d, t in texts.items():
        w = t.encode().lower().split()
        for i in range(len(w) - 50):
            seen.setdefault(tuple(w[i : i + 51]), set()).add(d)
    rows = queries()["op8_passages"](spark, DATA).collect()
    assert set().union(*(v for v in seen.values() if len(v) > 1)) <= {r["doc_id"] for r in rows} | {r["other_id"] for r in rows}


def test_secrets(spark, texts):
    from engram.llm.secrets import brute_force

    rows = queries()["op10_secrets"](spark, DATA).collect()
    assert {r["doc_id"]: r["base_sha256"] for r in rows} == {d: brute_force(t)[1] for d, t in texts.items()}


def test_licenses(spark, texts):
    from engram.llm.licenses import TEMPLATES

    words = lambda t: [w.lower() for w in re.findall("[A-Za-z0-9]+", t)]
    pairs = lambda w: list(zip(w, w[1:], strict=False))
    templates = [Counter(pairs(words(t))) for t in TEMPLATES.values()]

    def best(text):
        """The best score of all stretches; one that starts with an unshared bigram is never better than without it."""
        grams, top = pairs(words(text or "")), 0.0
        for template in templates:
            size = template.total()
            for i in (i for i, g in enumerate(grams) if g in template):
                left, shared = Counter(template), 0
                for n, g in enumerate(grams[i : i + 2 * size], 1):
                    if left[g] > 0:
                        left[g] -= 1
                        shared += 1
                        top = max(top, 2 * shared / (n + size))
        return top

    got = {}
    for r in queries()["op9_licenses"](spark, DATA).collect():
        got[r["doc_id"]] = max(r["score"], got.get(r["doc_id"], 0))
    want = {d: s for d, t in texts.items() if (s := best(t)) >= 0.8}
    assert want and got == pytest.approx(want)


def test_neighbours(spark):
    """The registered query on whole tables: exact scores and order, and the recall that is asked of it."""
    data = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    got = {}
    for r in queries()["op6_neighbours"](spark, data).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = {int(q): [] for q in ids[ids % 100 == 0]}
    for q in want:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        near = sorted((s, int(v)) for s, v in zip(d.tolist(), ids, strict=True) if v != q)[:10]
        want[q] = [v for _, v in near]
        far = dict(zip(ids.tolist(), d.tolist(), strict=True))
        assert [s for _, s in got[q]] == pytest.approx([far[v] for v, _ in got[q]], abs=1e-12)
        assert got[q] == sorted(got[q], key=lambda p: (p[1], p[0])) and len(got[q]) == len(near)
    assert got.keys() == want.keys()
    assert sum(len({v for v, _ in got[q]} & set(want[q])) for q in want) >= 0.9 * sum(map(len, want.values()))
