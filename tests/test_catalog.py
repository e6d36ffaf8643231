"""Every named query against its SQL, on the smallest tables."""

import os

import pytest

from engram.plans.catalog import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in data)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    import duckdb

    got = QUERIES[name](spark, DATA)
    data = got.collect()
    if name in SQL:
        c = duckdb.connect()
        c.sql("set timezone = 'UTC'")
        for f in os.listdir(DATA):
            c.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
        want = c.sql(SQL[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got.columns, data) == rows(want.columns, want.fetchall())


def test_entry_stands_without_the_corpus_operators(monkeypatch):
    import __spark_entry__ as e

    monkeypatch.setattr(e, "HAS_LLM", False)
    monkeypatch.setattr(e, "HAS_PIPELINE", False)
    assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) == set(SQL)
