"""Quantile sketches by day, merged over ranges, against exact ranks."""

import random
from bisect import bisect_left, bisect_right

import pytest

from engram.operators import metrics


def samples(spark):
    rng = random.Random(4)
    rows = [(f"2024-01-{1 + i % 20:02}", "ab"[i % 2], rng.lognormvariate(3, 1.5) if i % 7 else float(i % 5)) for i in range(20_000)]
    rows += [("2024-01-03", "a", None), ("2024-01-03", "a", float("nan"))]
    return rows, spark.createDataFrame(rows, "day string, kind string, ms double")


@pytest.mark.parametrize("first,last", [("2024-01-01", "2024-01-20"), ("2024-01-03", "2024-01-03"), ("2024-01-05", "2024-01-11")])
def test_merged_sketches_are_within_their_error(spark, first, last):
    rows, df = samples(spark)
    kept = metrics.daily_sketches(df, "ms", "day", ["kind"])
    for r in metrics.merged_latency(kept, "day", first, last, ["kind"]).collect():
        own = sorted(v for d, k, v in rows if k == r["kind"] and first <= d <= last and v is not None and v == v)
        assert (r["n"], r["low"], r["high"]) == (len(own), own[0], own[-1])
        for p, got in ((0.5, r["p50"]), (0.95, r["p95"]), (0.99, r["p99"])):
            assert bisect_left(own, got) / len(own) - 0.03 <= p <= bisect_right(own, got) / len(own) + 0.03


def test_nothing_to_merge(spark):
    kept = metrics.daily_sketches(samples(spark)[1], "ms", "day", ["kind"])
    assert metrics.merged_latency(kept, "day", "2025-01-01", "2025-02-01", ["kind"]).count() == 0
