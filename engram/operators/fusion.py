"""Reciprocal rank fusion of two ranked branches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.errors import ValidationError
from engram.operators.lexical import ranked
from engram.schemas import RRF_K, TOP_K


def fuse(lexical: DataFrame, vector: DataFrame, *, top_k: int = TOP_K, k: int = RRF_K) -> DataFrame:
    """``query_id, memory_id, score, lexical_rank, vector_rank, rank``.

    Both inputs have ``query_id, memory_id, rank``; of an id that a branch has
    twice the best rank counts. Order: score, number of branches, best rank, id.
    """
    if top_k < 1 or k < 1:
        raise ValidationError("top_k and k must be at least 1")
    tagged = lexical.select("query_id", "memory_id", F.col("rank").alias("l"), F.lit(None).cast("int").alias("v")).unionByName(
        vector.select("query_id", "memory_id", F.lit(None).cast("int").alias("l"), F.col("rank").alias("v"))
    )
    part = lambda c: F.coalesce(F.lit(1.0) / (F.col(c) + k), F.lit(0.0))
    both = tagged.groupBy("query_id", "memory_id").agg(F.min("l").alias("lexical_rank"), F.min("v").alias("vector_rank"))
    scored = both.withColumn("score", part("lexical_rank") + part("vector_rank"))
    branches = F.col("lexical_rank").isNotNull().cast("int") + F.col("vector_rank").isNotNull().cast("int")
    order = [F.col("score").desc(), branches.desc(), F.least("lexical_rank", "vector_rank").asc(), F.col("memory_id").asc()]
    return ranked(scored, order, top_k).select("query_id", "memory_id", "score", "lexical_rank", "vector_rank", "rank")


def fuse_lists(lexical: list[tuple[str, int]], vector: list[tuple[str, int]], *, top_k: int = TOP_K, k: int = RRF_K) -> list[tuple[str, float]]:
    """The same for two short lists of (id, rank) on the driver."""
    if top_k < 1 or k < 1 or any(r < 1 for _, r in [*lexical, *vector]):
        raise ValidationError("top_k, k and ranks must be at least 1")
    ranks: dict[str, list[int | None]] = {}
    for branch, rows in enumerate((lexical, vector)):
        for name, r in rows:
            own = ranks.setdefault(name, [None, None])
            own[branch] = r if own[branch] is None else min(own[branch], r)
    scored = []
    for name, own in ranks.items():
        known = [r for r in own if r is not None]
        scored.append((-sum(1 / (k + r) for r in known), -len(known), min(known), name))
    return [(name, -s) for s, _, _, name in sorted(scored)[:top_k]]
