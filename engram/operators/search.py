"""Hybrid search: both branches, their fusion, and previews of what is found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.operators.blocks import BlockIndex
from engram.operators.fusion import fuse
from engram.operators.lexical import lexical_branch
from engram.operators.scan import Filters, is_live
from engram.operators.vector import vector_branch
from engram.schemas import BRANCH_LIMIT, PREVIEW, TOP_K


def rank(memories: DataFrame, queries: DataFrame, *, now_ms: int, filters: Filters | None = None, top_k: int = TOP_K, limit: int = BRANCH_LIMIT, index: BlockIndex | None = None) -> DataFrame:
    """Fused ranks of ``queries`` (``query_id, brain_id, text, vector``), with each branch's evidence.

    A term-free text has no lexical branch, a null vector no vector branch.
    """
    eligible = is_live(now_ms) & (filters or Filters()).predicate()
    return fuse(lexical_branch(memories, queries, eligible, limit=limit, index=index), vector_branch(memories, queries, eligible, limit=limit), top_k=top_k)


def search(memories: DataFrame, queries: DataFrame, *, now_ms: int, filters: Filters | None = None, top_k: int = TOP_K, index: BlockIndex | None = None) -> DataFrame:
    """``query_id, rank`` and a preview of each hit. Only here are texts fetched, for the hits alone."""
    hits = rank(memories, queries, now_ms=now_ms, filters=filters, top_k=top_k, index=index).join(queries.select("query_id", "brain_id"), "query_id")
    shown = memories.where(is_live(now_ms)).withColumn("has_content", F.length("content") > 0).select("brain_id", *PREVIEW)
    return hits.select("query_id", "rank", "brain_id", "memory_id").join(shown, ["brain_id", "memory_id"]).select("query_id", "rank", *PREVIEW)
