"""Mixing sources to target weights by Poisson replication (native).

Each source gets a mean repetition rate ``target share * budget / source size``.
A document's count is the inverse of the Poisson distribution with that mean at
a uniform number derived from a keyed hash of its id, so that it depends on the
seed alone: no state, no sampling order, the same again when a task is rerun.
Copies are exploded and dealt to all partitions by a second keyed hash, of the
text as well, so that rows without an id are dealt out like all others.

Only the per-source totals are aggregated (partial sums before the shuffle, so
a source with a third of all rows costs no more than another), and only they
are broadcast, and that only up to ``max_broadcast_sources``; beyond, an
ordinary join is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.common import fresh, materialize, parallelism, text_or_empty

#: Above this mean the inversion would need more than a few hundred terms; rates are cut into parts instead.
_STEP = 16.0
_TERMS = 80


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) from 52 bits of MD5 over ``seed`` and ``key``."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def cdf_table(rate: Column) -> Column:
    """Cumulative Poisson probabilities for 0.._TERMS at a mean of at most _STEP."""
    first = F.exp(-rate)
    steps = F.sequence(F.lit(1), F.lit(_TERMS))
    zero = F.struct(first.alias("p"), F.array(first).alias("c"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return F.aggregate(steps, zero, step, lambda acc: acc["c"])


def mix_sources(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    *,
    epochs: float = 1.0,
    temperature: float = 0.7,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    copy_col: str = "copy",
    max_broadcast_sources: int = 100_000,
) -> DataFrame:
    """Replicate documents so that sources reach their target shares of characters.

    ``weights`` maps source to relative target weight; sources it leaves out get
    0. Without it, weights are ``size ** temperature``. ``epochs`` is the size of
    the result as a multiple of the input. Output: the input's columns and
    ``copy_col`` (1..count), in an order dealt anew by hash.

    Nulls: a null source is a source of its own, a null text has length 0, a null
    id hashes like the empty id. A source whose texts are all empty has rate
    ``epochs``. Repeated rows have the same id and so the same count each. An
    empty table gives an empty table. Columns may have any names; a clashing
    ``copy_col`` is lengthened by underscores until it is free.
    """
    spark = docs.sparkSession
    copy_col = fresh(copy_col, docs.columns)
    of, parts, cdf, n = (fresh(c, [*docs.columns, copy_col]) for c in ("_s", "_parts", "_cdf", "_n"))
    size = F.coalesce(F.length(text_or_empty(text_col)).cast("long"), F.lit(0))
    source = F.col(source_col).cast("string")
    stats = docs.groupBy(source.alias("_s")).agg(F.sum(size).alias("_size"))
    if weights is None:
        weight = F.pow(F.col("_size").cast("double"), F.lit(float(temperature)))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("_s").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    stats = materialize(stats.withColumn("_w", weight), "mix-sources")
    whole = stats.agg(F.sum("_w").alias("w"), F.sum("_size").alias("n"), F.count("*").alias("sources")).first()
    total_w, total_n = float(whole["w"] or 0.0), float(whole["n"] or 0)
    target = F.col("_w") / F.lit(total_w if total_w > 0 else 1.0) * F.lit(total_n * epochs)
    rate = F.when(F.col("_size") > 0, target / F.greatest(F.col("_size"), F.lit(1))).otherwise(F.lit(float(epochs)))
    # A Poisson variable with a large mean is a sum of independent ones with means of at most _STEP.
    stats = (
        stats.withColumn("_rate", rate)
        .withColumn("_parts", F.greatest(F.ceil(F.col("_rate") / _STEP), F.lit(1)).cast("int"))
        .select(F.col("_s").alias(of), F.col("_parts").alias(parts), cdf_table(F.col("_rate") / F.col("_parts")).alias(cdf))
    )
    if whole["sources"] <= max_broadcast_sources:
        stats = F.broadcast(stats)
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))

    def draws(part: Column) -> Column:
        u = uniform(F.concat(key, F.lit("/"), part.cast("string")), seed)
        return F.size(F.filter(F.col(cdf), lambda c: c <= u))

    count = F.aggregate(F.sequence(F.lit(1), F.col(parts)), F.lit(0), lambda acc, part: acc + draws(part))
    out = (
        docs.join(stats, F.col(source_col).cast("string").eqNullSafe(F.col(of)))
        .withColumn(n, count)
        .where(F.col(n) > 0)
        .select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(n))).alias(copy_col))
    )
    place = fresh("_place", out.columns)
    out = out.withColumn(place, F.md5(F.concat(F.lit(f"{seed}#"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("/"), F.col(copy_col).cast("string"), F.lit("/"), F.xxhash64(text_or_empty(text_col)).cast("string")).cast("binary")))
    return out.repartition(parallelism(spark), place).sortWithinPartitions(place).drop(place)
