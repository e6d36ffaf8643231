"""Helpers shared by the corpus operators: tables, shared storage, text columns."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none and runs in one process, as in tests, a
    temporary folder is made and kept in the session's settings; a cluster
    without the setting is an error, as executors would not see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="engram-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: With this setting a query's shuffle files go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to shared storage and read it back.

    This cuts the lineage and survives the loss of executors; later readers
    prune columns, which ``checkpoint()`` cannot do. The write's shuffle files
    are removed with it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/engram/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._engram_path = path
    return out


def discard(*written: DataFrame | Bloom) -> None:
    """Delete what ``materialize`` wrote, once nothing is going to read it."""
    for df in written:
        df = df.one if isinstance(df, Bloom) else df
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._engram_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def parallelism(spark: SparkSession) -> int:
    """How many partitions an explicit repartition gets."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def sliced(batches: Iterable, rows: int = 1024) -> Iterator:
    """Arrow batches in slices, so that only so many rows are Python objects at a time."""
    for b in batches:
        for start in range(0, b.num_rows, rows):
            yield b.slice(start, rows)


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def fresh(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column of ``taken`` has it (case ignored)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def running(rows: DataFrame, group: list[str], order: list[Column], values: dict[str, tuple[Callable, Column]]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with each value's running aggregate within ``group``, this row included; and a table to ``discard`` later.

    ``values`` has a function (``F.sum`` or ``F.bit_xor``) and a column of longs
    by new name. Rows are dealt out by ranges of (group, order), aggregated
    within their range, and what earlier ranges of the same group hold is added,
    so a group of any size is in as many tasks as its share of the rows. Fewer
    groups lie in several ranges than there are ranges, and only their parts are
    broadcast. Null is a group, too.
    """
    taken = [*rows.columns, *values]
    block, many = fresh("_block", taken), fresh("_many", taken)
    was = {g: fresh(f"_of_{g}", taken) for g in group}
    before = {k: fresh(f"_before_{k}", taken) for k in values}
    cut = materialize(rows.repartitionByRange(parallelism(rows.sparkSession), *group, *order).withColumn(block, F.spark_partition_id()), "blocks")
    parts = cut.groupBy(*group, block).agg(*(f(v).alias(before[k]) for k, (f, v) in values.items()))
    within = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    several = parts.withColumn(many, F.count("*").over(Window.partitionBy(*group))).where(F.col(many) > 1)
    carried = several.select(*(F.col(g).alias(w) for g, w in was.items()), F.col(block).alias(many), *(f(before[k]).over(within).alias(before[k]) for k, (f, _) in values.items()))
    here = Window.partitionBy(*group, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = F.col(block) == F.col(many)
    for g, w in was.items():
        same &= F.col(g).eqNullSafe(F.col(w))
    joined = cut.withColumns({k: f(v).over(here) for k, (f, v) in values.items()}).join(F.broadcast(carried), same, "left")
    started = {k: F.coalesce(F.col(b), F.lit(0).cast("long")) for k, b in before.items()}
    total = {k: F.col(k).bitwiseXOR(started[k]) if f is F.bit_xor else F.col(k) + started[k] for k, (f, _) in values.items()}
    return joined.select(*rows.columns, *(v.alias(k) for k, v in total.items())), cut


class Bloom:
    """A Bloom filter over longs whose size is bounded whatever the input (native).

    Beyond ``2**max_bits`` bits' capacity more keys pass by mistake, which costs
    readers some work but no result: they filter exactly afterwards. The filter
    is made by aggregations and kept as a written table of one row, of
    ``2**(max_bits - 3)`` bytes at most; the driver's Python never sees it.
    """

    _CHUNK = 10

    def __init__(self, one: DataFrame, bits: int) -> None:
        self.one, self.bits = one, bits

    @classmethod
    def of(cls, keys: DataFrame, *cols: str, max_bits: int = 26) -> Bloom:
        spark, n = keys.sparkSession, keys.count()
        bits = min(max(16, int(12 * n).bit_length()), max_bits)
        at = keys.select(F.explode(F.array(*cls._slots(cls._hashes(*map(F.col, cols)), bits))).alias("_at"))
        masks = at.select(F.shiftrightunsigned("_at", 6).alias("word"), F.expr("shiftleft(1L, cast(_at & 63 as int))").alias("mask"))
        words = masks.unionByName(spark.range(1 << (bits - 6)).selectExpr("id word", "0L mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))
        in_order = lambda col: F.array_sort(F.collect_list(col))
        chunks = words.groupBy(F.shiftright("word", cls._CHUNK).alias("chunk")).agg(in_order(F.struct("word", "mask")).alias("part"))
        parts = chunks.select(F.struct("chunk", F.col("part.mask").alias("mask")).alias("part"))  # 2**(bits - 16) rows
        return cls(materialize(parts.agg(F.flatten(in_order("part")["mask"]).alias("_bloom")), "bloom"), bits)

    @staticmethod
    def _hashes(*key: Column) -> list[Column]:
        return [F.xxhash64(*key), F.xxhash64(*key, F.lit(1))]

    @staticmethod
    def _slots(hashes: list[Column], bits: int) -> list[Column]:
        low = F.lit((1 << bits) - 1)
        return [at for h in hashes for at in (F.shiftrightunsigned(h, 64 - bits), h.bitwiseAND(low))]

    def maybe(self, df: DataFrame, *cols: str) -> DataFrame:
        """The rows of ``df`` that may have a key.

        The filter's one row is broadcast and looked up in the join's condition,
        so rows are only dropped and nothing is paired.
        """
        word = lambda at: F.get(F.col("_bloom"), F.shiftrightunsigned(at, 6).cast("int"))
        bit = lambda at: F.call_function("shiftrightunsigned", word(at), at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
        found = F.lit(True)
        for at in self._slots(self._hashes(*map(F.col, cols)), self.bits):
            found &= bit(at)
        return df.join(F.broadcast(self.one), found, "left_semi")


#: Keys up to this number are broadcast themselves.
FEW_KEYS = 50_000


def among(rows: DataFrame, keys: DataFrame, *cols: str) -> tuple[DataFrame, list[Bloom]]:
    """The rows of ``rows`` whose ``cols`` are in ``keys``, by a semi join.

    Where there are many keys, a Bloom filter goes before it, so that hardly any
    other rows are shuffled; it is to be discarded once the result is written.
    """
    if keys.count() <= FEW_KEYS:
        return rows.join(F.broadcast(keys.select(*cols)), [*cols], "left_semi"), []
    bloom = Bloom.of(keys, *cols)
    return bloom.maybe(rows, *cols).join(keys.select(*cols), [*cols], "left_semi"), [bloom]


def components(edges: DataFrame) -> DataFrame:
    """``id, label``, written: the smallest id of each id's connected component, for ids with an edge.

    ``edges`` has two long columns. Alternating large-star and small-star steps;
    minima are aggregated before the shuffle, joins can be split where one node
    has very many edges, and each step is written to shared storage.
    """
    a, b = (F.col(c) for c in edges.columns)
    e = materialize(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or now[0] == 0:
            out = materialize(e.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct()), "components")
            discard(e)
            return out
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(small, "u")
        nearer = materialize(linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(e)
        e = nearer
