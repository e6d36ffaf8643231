"""Vector search in blocks and from quantised vectors against the plain scan."""

import random

import pytest
from pyspark.sql import functions as F

from engram.operators import vector
from engram.schemas import MEMORIES

DIM = 16


def rows(spark, n, dim=DIM, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        v = [rng.gauss(0, 1) + (i % 5) for _ in range(dim)]
        v = {3: None, 4: v[:-1], 5: [0.0] * dim, 6: [float("nan")] * dim, 7: [1e30 * x for x in v], 8: [float("inf")] * dim, 9: []}.get(i, v)
        if i % 50 >= 45:
            v = [1.0] * dim  # ties
        out.append((f"m{i:05}", "b" if i % 4 else "c", "a", "t", "c", "s", "", "1970-01-01", None, None, 1, 1, 3, 2, None, "{}", "p", 1, v))
    return spark.createDataFrame(out, MEMORIES)


def questions(spark, n, dim=DIM):
    rng = random.Random(2)
    asked = [(f"q{i}", "bc?"[i % 3 if i % 7 else 2], [rng.gauss(0.5, 1) for _ in range(dim)]) for i in range(n)] + [("ties", "b", [1.0] * dim), ("null", "b", None), ("short", "b", [1.0] * (dim - 1)), ("zero", "b", [0.0] * dim)]
    return spark.createDataFrame(asked, "query_id string, brain_id string, vector array<double>")


def found(df):
    return sorted((r["query_id"], r["rank"], r["memory_id"], r["key"]) for r in df.collect())


def plain(m, q, **kw):
    """Every pair, natively."""
    ok = m.where(vector.well_formed(F.col("embedding"), F.size("embedding")))
    pairs = ok.join(q.where("vector is not null"), "brain_id").where(F.size("vector") == F.size("embedding"))
    keys = pairs.select("query_id", "memory_id", vector.micro_key(vector.cosine(F.col("embedding"), F.col("vector"))).alias("key")).where(F.col("key") >= kw.get("floor", 300_000))
    return found(vector.ranked(keys, [F.col("key").desc(), F.col("memory_id").asc()], kw.get("limit", 50)))


@pytest.mark.parametrize("how", ["sent", "blocks", "quantised"])
@pytest.mark.parametrize("kw", [{}, {"limit": 3, "floor": -2_000_000}])
def test_all_ways_give_what_every_pair_gives(spark, monkeypatch, how, kw):
    m, q = rows(spark, 700), questions(spark, 20)
    if how == "blocks":
        for name, value in (("MAX_SENT", 3), ("QUERY_BLOCK", 6), ("ROW_BLOCK", 100)):
            monkeypatch.setattr(vector, name, value)
    if how == "quantised":
        m = vector.quantised(m)
    assert found(vector.vector_branch(m, q, F.lit(True), **kw)) == plain(m, q, **kw)


def test_many_ids_are_joined(spark, monkeypatch):
    monkeypatch.setattr(vector, "MAX_PUSHED_IDS", 5)
    m, q = vector.quantised(rows(spark, 300)), questions(spark, 4)
    assert found(vector.vector_branch(m, q, F.lit(True))) == plain(m, q)
    assert vector.vector_branch(m.limit(0), q, F.lit(True)).count() == vector.vector_branch(m, q.limit(0), F.lit(True)).count() == 0


def test_error_bounds_hold(spark):
    m = vector.quantised(rows(spark, 300)).where("code is not null")
    q = F.array(*(F.lit(float(x)) for x in [random.Random(5).gauss(0, 1) for _ in range(DIM)]))
    codes = F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda i: F.conv(F.hex(F.substr(F.col("code"), i + 1, F.lit(1))), 16, 10).cast("int"))
    signed = F.transform(codes, lambda c: (F.when(c > 127, c - 256).otherwise(c) * F.col("step")).cast("double"))
    off = F.abs(vector.cosine(F.col("embedding"), q) - F.aggregate(F.zip_with(signed, q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) / vector.norm(q))
    worst = m.agg(F.max(off - F.col("error")), F.max("error"), F.count("*")).first()
    assert worst[0] <= 0 and worst[1] < 0.02 and worst[2] > 200


def read_mb(spark):
    """What tasks have read so far, in MB."""
    found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(found.apply(i).totalInputBytes() for i in range(found.size())) / 1e6


def test_few_bytes_are_read(spark, tmp_path):
    dim = 256
    stored = vector.quantised(rows(spark, 8_000, dim)).coalesce(1).sortWithinPartitions("brain_id", "memory_id")
    stored.write.option("parquet.page.row.count.limit", 256).parquet(f"{tmp_path}/q")
    m, q = spark.read.parquet(f"{tmp_path}/q"), questions(spark, 1, dim).where("query_id = 'q0'")
    took = []
    spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")  # whose bytes are not counted
    for df in (m.drop("code"), m):
        before = read_mb(spark)
        found(vector.vector_branch(df, q, F.lit(True), limit=5))
        took.append(read_mb(spark) - before)
    spark.conf.unset("parquet.hadoop.vectored.io.enabled")
    assert took[0] > 6 and took[1] < 0.4 * took[0], took
