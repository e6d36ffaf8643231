"""Hamerly's clustering against plain k-means in whole numbers."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from engram.llm.clusters import cluster_vectors
from engram.llm.queries import op13_clusters

SCHEMA = "vec_id long, embedding array<float>"


def brute_force(rows, k=16, rounds=3, dim=64):
    kept = [(i, [math.floor(64 * x) if abs(x) < 1e15 else int(x) * 64 for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [list(v) for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            if own:
                centroids[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = [(i, *near(v)) for i, v in kept]
    fits = lambda n: n if n < 2**63 else None
    inertia = {j: sum(d for _, d, c in out if c == j) for j in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, fits(d), fits(inertia[c]), fits(sum(inertia.values())), sha[c]) for i, d, c in out), key=str)


def found(df):
    return sorted((tuple(r)[:6] for r in df.collect()), key=str)


def floats(spark, rows):
    """Rows as Spark has them: components rounded to 32 bits."""
    df = spark.createDataFrame(rows, SCHEMA)
    return df, [(r["vec_id"], r["embedding"]) for r in df.collect()]


def clustered(n, dim=64, seed=2):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(20)]
    return [(i, [m + rng.gauss(0, 0.3) for m in middles[i % 20]]) for i in range(n)]


def test_like_plain_k_means(spark):
    df, rows = floats(spark, clustered(900))
    got = cluster_vectors(df.repartition(6))
    assert found(got) == brute_force(rows)
    scans = got.agg(F.avg("scans")).first()[0]
    assert 1 <= scans < 3  # bounds spare full comparisons


def test_ties_copies_and_unusable_rows(spark):
    good = clustered(40)
    rows = [*good, (3, good[3][1]), (3, good[5][1]), (None, good[6][1])]
    rows += [(100 + i, good[7][1]) for i in range(60)]  # one common vector
    rows += [(200, None), (201, [1.0] * 63), (202, [*([0.0] * 63), float("nan")]), (203, [float("inf")] * 64), (204, [*([0.0] * 63), None]), (205, []), (206, [0.0] * 64), (207, [-0.001] * 64)]
    rows += [(300 + i, [float(i % 2)] * 64) for i in range(20)]
    df, rows = floats(spark, rows)
    assert found(cluster_vectors(df)) == brute_force(rows)


def test_few_rows_and_none(spark):
    for rows in ([], clustered(1), clustered(5)):
        df, rows = floats(spark, rows)
        assert found(cluster_vectors(df)) == brute_force(rows)
    assert cluster_vectors(spark.createDataFrame([], SCHEMA)).columns == cluster_vectors(df).columns


@pytest.mark.parametrize("size", [1e4, 1e9, 1e30, 3e38])
def test_large_components(spark, size):
    rng = random.Random(9)
    df, rows = floats(spark, [(i, [size * rng.uniform(-1, 1) for _ in range(64)]) for i in range(40)] + clustered(10, seed=3))
    assert found(cluster_vectors(df)) == brute_force(rows)


def test_names_and_parameters(spark):
    rows = [(i, v[:8]) for i, v in clustered(200)]
    df, rows = floats(spark, rows)
    wide = df.withColumns({n: F.lit("mine") for n in ("x", "cluster", "upper", "lower", "distance", "scans", "_h", "inertia")}).withColumnRenamed("vec_id", "key")
    assert found(cluster_vectors(wide, k=3, rounds=6, dim=8, id_col="key")) == brute_force(rows, 3, 6, 8)


def test_registered_query(spark, tmp_path):
    df, rows = floats(spark, clustered(300))
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op13_clusters(spark, str(tmp_path))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert found(got) == brute_force(rows)
