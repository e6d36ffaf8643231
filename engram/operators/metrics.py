"""Quality of rankings against graded judgments, and latency percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quality(ranking: DataFrame, judgments: DataFrame, *, recall_at: int = 5, ndcg_at: int = 10) -> DataFrame:
    """One row ``recall, mrr, ndcg``, means over the judged queries.

    ``ranking`` has ``query_id, doc_id, rank``; ``judgments`` ``query_id, doc_id,
    grade``. Relevant is a grade of 1 or more; recall's denominator is at most
    ``recall_at``; gains are grades over log2(rank + 1), the ideal from the
    sorted judged grades; reciprocal rank looks at the whole ranking.
    """
    hit = judgments.join(ranking, ["query_id", "doc_id"], "left")
    gain = lambda pos: F.col("grade") / F.log2(F.col(pos) + 1)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id"))
    relevant = F.col("grade") >= 1
    per = (
        hit.withColumn("ideal", best)
        .groupBy("query_id")
        .agg(
            F.count_if(relevant).alias("n"),
            F.count_if(relevant & (F.col("rank") <= recall_at)).alias("found"),
            F.min(F.when(relevant, F.col("rank"))).alias("first"),
            F.coalesce(F.sum(F.when(F.col("rank") <= ndcg_at, gain("rank"))), F.lit(0.0)).alias("dcg"),
            F.sum(F.when(F.col("ideal") <= ndcg_at, gain("ideal"))).alias("idcg"),
        )
    )
    recall = F.coalesce(F.try_divide(F.col("found"), F.least(F.lit(recall_at), F.col("n"))), F.lit(0.0))
    return per.agg(
        F.avg(recall).alias("recall"),
        F.avg(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))).alias("mrr"),
        F.avg(F.coalesce(F.try_divide("dcg", "idcg"), F.lit(0.0))).alias("ndcg"),
    )


def latency(samples: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Exact interpolated p50, p95 and p99."""
    points = [F.percentile(value, F.lit(p)).alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)]
    return samples.groupBy(*(by or [])).agg(*points)


#: Size of a quantile sketch; ranks are off by about 1.3 % of the number of values.
SKETCH_K = 200


def daily_sketches(samples: DataFrame, value: str, day: str, by: list[str] | None = None) -> DataFrame:
    """A quantile sketch for each ``day`` (and ``by``): ``day, sketch, n, low, high``.

    Sketches are small and can be merged, so a day's values are read once and any
    range of days is answered from what is kept. Nulls and NaN are left out.
    """
    v = F.col(value).cast("double")
    return samples.where(v.isNotNull() & ~F.isnan(v)).groupBy(*(by or []), day).agg(F.kll_sketch_agg_double(v, SKETCH_K).alias("sketch"), F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high"))


def merged_latency(sketches: DataFrame, day: str, first: str, last: str, by: list[str] | None = None) -> DataFrame:
    """About p50, p95 and p99 of the days from ``first`` to ``last``, with ``n, low, high``, which are exact."""
    own = sketches.where(F.col(day).between(first, last)).groupBy(*(by or []))
    merged = own.agg(F.kll_merge_agg_double("sketch", SKETCH_K).alias("_s"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    return merged.select(*(by or []), *(F.kll_sketch_get_quantile_double("_s", F.lit(p)).alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)), "n", "low", "high")
