"""The corpus pipeline: filter, dedup, mix and pack ``documents``.

Each stage takes (session, documents, folder of tables) and gives a table that
is written and read again as the next one's documents. All but the last keep
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import discard, fresh, materialize, table
from engram.llm.jaccard import keep_one_of_each
from engram.llm.lines import dedup_lines
from engram.llm.mixing import mix_sources
from engram.llm.packing import pack_documents
from engram.llm.toxicity import drop_toxic, train

#: No SQL: the classifier is trained and packing is sequential.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under one half."""
    return drop_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that occurred before go; a document all of whose lines do goes with them."""
    dropped = fresh("_dropped", docs.columns)
    out = dedup_lines(docs, count_col=dropped)
    left = F.col("text").isNull() | (F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    out = out.where((F.col(dropped) == 0) | left)
    n = F.when(F.col(dropped) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word shingle similarity of 0.8 or more."""
    return keep_one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated so that sources reach their target shares."""
    return mix_sources(docs).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of permitted sequence lengths, with each piece's text; (``doc_id``, ``copy``, ``piece``) is a key."""
    return pack_documents(docs, with_text=True)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next one reads it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
