"""A lexical index of blocks, kept up to date by segments.

Rows are laid out in tiles of a few rows of one brain and similar length. A
posting block holds a term's rows of one tile, and the peaks of its
frequencies: the pairs of frequency and length that no other row of the block
beats in both. Whatever the statistics are by then, a block's largest
contribution is that of one of its peaks, so bounds are exact and never go
stale.

A search of few postings scores all of them. Beyond that it adds up, for each
tile, the bounds of the query's terms. The best tiles are scored first and give a
score that the wanted number of rows reach. Terms whose largest bounds together
do not reach it cannot make a row good by themselves: the rows of the others are
scored first, in tiles whose bound reaches the score, and only those that could
still reach it have the remaining terms looked up, in their own tiles. No row that
is left out can be among the best, so the result is that of scoring everything.
A bounded number of queries is sent to every task instead of being joined: tiles
whose bound reaches some query's score are then scored for all of them at once.

Every append writes a segment of its own, and every removal one with the terms
of the rows that went; both read the texts of these rows only. Segments of
similar size are merged from their blocks, without any text, and removed rows
are left out then. An index is a value: a folder and a list of segments, which
its owner keeps. Segments are never changed.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from engram.operators.counts import Scores, in_blocks, row_lengths, token_lists
from engram.operators.lexical import MAX_SENT_TERMS, contribution, idf, query_terms, ranked, sent_terms, tokenized

#: Rows of a tile, as a power of two.
TILE_BITS = 4
#: Segments of one size class that are merged into one.
FANOUT = 8
#: Segments of up to so many rows are written as one file.
FEW_ROWS = 2_000
#: Merged segments of up to so many rows are laid out in tiles anew; larger ones keep the tiles that their parts have filled.
MAX_LAID_ROWS = FANOUT * FEW_ROWS
#: Beyond the session's number, files of a segment have about so many rows.
FILE_ROWS = 20_000
#: Removed rows up to this number are sent to every task; beyond, they are joined by shuffle.
MAX_SENT_GONE = 500_000
#: Terms up to this number are pushed down to the files; up to the next one they are sent to every task, beyond they are joined.
MAX_PUSHED_TERMS, MAX_HELD_TERMS = 2_000, 100_000
#: Of up to so many queries the scores to reach are held, a number each; of more they are part of the plan.
MAX_HELD_QUERIES = 10_000
#: Of queries that are sent to every task, tiles to score up to this number are sent as well; more are joined.
MAX_SENT_TILES = 200_000
#: Fewer postings than these are all scored in one pass, which is quicker than looking for those that matter.
SCORE_ALL = 20_000_000
#: Bounds are raised by this share, so that rounding cannot lower one below a score.
SLACK = 1 + 1e-9

#: Rows of a page of blocks, which is what a term's search reads of a file's stretch.
PAGE_ROWS = 4_096

BLOCKS = "seq bigint, term string, brain_id string, tile bigint, n bigint, peaks array<struct<tf:double,len:bigint>>, docs array<struct<memory_id:string,tf:double,len:bigint>>"
GONE = "seq bigint, term string, brain_id string, memory_id string, len bigint"


@dataclass(frozen=True)
class Segment:
    """``rows`` and ``tokens`` count what it adds, or takes away if ``removal``; ``seq`` orders segments in time.

    Rows of a segment carry its ``seq``; those of merged removals, and of merged segments that keep their tiles, the ones they came with.
    """

    name: str
    seq: int
    rows: int
    tokens: int
    removal: bool = False


class BlockIndex:
    def __init__(self, spark: SparkSession, path: str, segments: tuple[Segment, ...] = ()) -> None:
        self.spark, self.path, self.segments = spark, path.rstrip("/"), tuple(segments)

    # -------------------------------------------------------------- what the owner keeps

    def state(self) -> dict:
        return {"path": self.path, "segments": [asdict(s) for s in self.segments]}

    @classmethod
    def of_state(cls, spark: SparkSession, state: dict) -> BlockIndex:
        return cls(spark, state["path"], tuple(Segment(**s) for s in state["segments"]))

    @classmethod
    def build(cls, memories: DataFrame, path: str) -> BlockIndex:
        return cls(memories.sparkSession, path).append(memories)

    # -------------------------------------------------------------- segments

    def _next(self) -> int:
        return max((s.seq for s in self.segments), default=0) + 1

    def append(self, memories: DataFrame) -> BlockIndex:
        """The index with the rows of ``memories`` added; only their texts are read."""
        rows, tokens = row_lengths(memories).agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
        if not rows:
            return self
        seq, lists = self._next(), token_lists(memories if rows > FEW_ROWS else memories.coalesce(1), "brain_id", "memory_id")
        # Tiles are laid out and their blocks made where the rows are read, so neither texts nor postings are shuffled.
        return self._written(lists.mapInArrow(lambda batches: in_blocks(batches, seq, TILE_BITS), BLOCKS), Segment(uuid.uuid4().hex, seq, rows, tokens))

    def remove(self, memories: DataFrame) -> BlockIndex:
        """The index without the rows of ``memories``, whose texts are those that were added; no other text is read."""
        rows = tokenized(memories).select("brain_id", "memory_id", "_len", F.array_distinct(F.transform("_tok", lambda t: t["term"])).alias("terms"))
        # A row without tokens is kept by its key alone.
        return self._remove(rows.select(F.lit(self._next()).cast("long").alias("seq"), F.explode_outer("terms").alias("term"), "brain_id", "memory_id", F.col("_len").alias("len")), self._next())

    def _remove(self, gone: DataFrame, seq: int) -> BlockIndex:
        name = uuid.uuid4().hex
        _ranged(gone, self._parts(), "term", "brain_id", "memory_id").write.parquet(f"{self.path}/gone/{name}")
        written = self.spark.read.schema(GONE).parquet(f"{self.path}/gone/{name}").groupBy("brain_id", "memory_id", "seq").agg(F.max("len").alias("len"))
        n, tokens = written.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
        return BlockIndex(self.spark, self.path, (*self.segments, Segment(name, seq, n, tokens, True))) if n else self

    def merged(self, fanout: int = FANOUT) -> BlockIndex:
        """The index with segments of one size class made one wherever there are ``fanout`` of them, again and again; removals likewise."""
        out = self
        while True:
            classes = defaultdict(list)
            for s in out._live():
                classes[int(math.log(max(s.rows, 1), fanout))].append(s)
            full = next((c for _, c in sorted(classes.items()) if len(c) >= fanout), None)
            if full is not None:
                out = out._merge(full)
            elif len(out._removals()) >= fanout:
                out = out._without_removals()._remove(out._read("gone", out._removals()), max(s.seq for s in out._removals()))
            else:
                return out

    def _without_removals(self) -> BlockIndex:
        return BlockIndex(self.spark, self.path, tuple(self._live()))

    def _merge(self, these: list[Segment]) -> BlockIndex:
        """One segment of ``these`` without the rows that later removals took away, and one removal of what is left of these."""
        key, names, fewer = ["seq", "brain_id", "memory_id"], {s.name for s in these}, 0
        rows = self._read("blocks", these).select("seq", "term", "brain_id", "tile", F.explode("docs").alias("d")).select("seq", "term", "brain_id", "tile", "d.*")
        out = BlockIndex(self.spark, self.path, tuple(s for s in self.segments if s.name not in names))
        if removals := self._removals():
            gone = self._read("gone", removals)
            removed = gone.select("brain_id", "memory_id", F.col("seq").alias("_gone")).distinct()
            # A row without tokens is in no block: its removal stays.
            went = rows.select(*key).distinct().join(removed, ["brain_id", "memory_id"]).where(F.col("seq") < F.col("_gone"))
            went = went.groupBy(*key).agg(F.min("_gone").alias("_gone"))
            fewer = went.count()
            if fewer:
                rows = rows.join(went.select(*key), key, "left_anti")
                left = gone.join(went.select("brain_id", "memory_id", F.col("_gone").alias("seq")), key, "left_anti")
                out = out._without_removals()._remove(left, max(s.seq for s in removals))
        left = sum(s.rows for s in these) - fewer
        if left > MAX_LAID_ROWS:
            seq, tokens = max(s.seq for s in these), sum(s.tokens for s in these)
            if not fewer:
                # Small files are read together, so they become one.
                return out._written(self._read("blocks", these), Segment(uuid.uuid4().hex, seq, left, tokens))
            lost = self._read("gone", removals).join(went.select("brain_id", "memory_id", F.col("_gone").alias("seq")), ["brain_id", "memory_id", "seq"])
            lost = lost.groupBy("brain_id", "memory_id", "seq").agg(F.max("len").alias("len")).agg(F.coalesce(F.sum("len"), F.lit(0))).first()[0]
            return out._written(_ranged(_blocks(rows), self._parts(left), "term", "brain_id", "seq", "tile"), Segment(uuid.uuid4().hex, seq, left, tokens - lost))
        post = rows.drop("tile").join(_in_tiles(rows.select(*key, "len").distinct(), self._parts(left)).select(*key, "tile"), key)
        return out._add(post, max(s.seq for s in these), rows=left)

    def _add(self, post: DataFrame, seq: int, *, rows: int) -> BlockIndex:
        """Write a segment of ``brain_id, memory_id, tile, len, term, tf``."""
        if not rows:
            return self
        name = uuid.uuid4().hex
        _ranged(_blocks(post.withColumn("seq", F.lit(seq).cast("long"))), self._parts(rows), "term", "brain_id", "tile").write.parquet(f"{self.path}/blocks/{name}")
        docs = self.spark.read.schema(BLOCKS).parquet(f"{self.path}/blocks/{name}").select("brain_id", F.explode("docs").alias("d"))
        tokens = docs.groupBy("brain_id", "d.memory_id").agg(F.max("d.len").alias("len")).agg(F.coalesce(F.sum("len"), F.lit(0))).first()[0]
        return BlockIndex(self.spark, self.path, (*self.segments, Segment(name, seq, rows, tokens)))

    def _written(self, blocks: DataFrame, segment: Segment) -> BlockIndex:
        """The index with ``segment``, whose ``blocks`` are written in the order they come in."""
        blocks.write.option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{self.path}/blocks/{segment.name}")
        return BlockIndex(self.spark, self.path, (*self.segments, segment))

    def _parts(self, rows: int | None = None) -> int:
        """Files of a segment: one for a few rows, which then need no sample of their ranges."""
        few = rows is not None and rows <= FEW_ROWS
        return 1 if few else max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-(rows or 0) // FILE_ROWS))

    def _read(self, kind: str, segments: list[Segment]) -> DataFrame:
        schema = BLOCKS if kind == "blocks" else GONE
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{kind}/{s.name}" for s in segments)) if segments else self.spark.createDataFrame([], schema)

    # -------------------------------------------------------------- what it says

    def _live(self) -> list[Segment]:
        return [s for s in self.segments if not s.removal]

    def _removals(self) -> list[Segment]:
        return [s for s in self.segments if s.removal]

    def counts(self) -> tuple[int, int]:
        """Rows and tokens."""
        sign = [(-1 if s.removal else 1, s) for s in self.segments]
        return sum(x * s.rows for x, s in sign), sum(x * s.tokens for x, s in sign)

    def stats(self) -> DataFrame:
        """One row, as ``lexical.corpus_stats`` has it."""
        rows, tokens = self.counts()
        return self.spark.createDataFrame([(rows, tokens, tokens / rows if rows else None)], "n_rows bigint, n_tokens bigint, avg_len double")

    def term_df(self, terms: DataFrame | None = None) -> DataFrame:
        """``term, df`` of all terms, or of those in ``terms``."""
        return self._df(lambda df: df if terms is None else df.join(terms, "term", "left_semi"))

    def _df(self, of: Callable[[DataFrame], DataFrame]) -> DataFrame:
        there = of(self._read("blocks", self._live())).select("term", "n")
        if self._removals():
            gone = of(self._read("gone", self._removals())).where("term is not null")
            there = there.unionByName(gone.select("term", F.lit(-1).cast("long").alias("n")))
        return there.groupBy("term").agg(F.sum("n").alias("df")).where("df > 0")

    def postings(self) -> DataFrame:
        """``brain_id, memory_id, term, tf, len`` of the rows that are there, as ``lexical.postings`` has them."""
        rows = self._read("blocks", self._live()).select("seq", "brain_id", "term", F.explode("docs").alias("d")).select("seq", "brain_id", "term", "d.*")
        return self._there(rows).select("brain_id", "memory_id", "term", "tf", "len")

    def _there(self, rows: DataFrame) -> DataFrame:
        """Those of ``rows`` (``seq, brain_id, memory_id`` and more) that no later removal took away."""
        if not self._removals():
            return rows
        gone = self._read("gone", self._removals()).groupBy("brain_id", "memory_id").agg(F.max("seq").alias("_gone"))
        gone = F.broadcast(gone) if sum(s.rows for s in self._removals()) <= MAX_SENT_GONE else gone
        return rows.join(gone, ["brain_id", "memory_id"], "left").where(F.col("_gone").isNull() | (F.col("seq") > F.col("_gone"))).drop("_gone")

    # -------------------------------------------------------------- search

    def search(self, memories: DataFrame, queries: DataFrame, eligible: Column, *, limit: int, score_all: int = SCORE_ALL) -> DataFrame:
        """``query_id, memory_id, score, rank``, equal to scoring every posting."""
        s = _Search(self, memories.where(eligible), queries, limit)
        few = s.postings is not None and s.postings < score_all
        if s.sent is not None:
            return s.scored() if few else s.scored(s.tiles())
        return s.best(s.everything() if few else s.that_matters())

    def blocks_read(self, memories: DataFrame, queries: DataFrame, eligible: Column, *, limit: int) -> DataFrame:
        """``query_id, term, df, n_blocks, n_read``: how many of a term's blocks in the query's brain a search by bounds scores if queries are joined."""
        s = _Search(self, memories.where(eligible), queries, limit)
        key = ["query_id", "term", *_TILE[1:]]
        read = [s.in_tiles(s.first()), s.in_tiles(s.reached(), needed=True), s.in_tiles(s.candidates().select(*_TILE).distinct(), needed=False)]
        marked = reduce(DataFrame.unionByName, (r.select(*key) for r in read)).distinct().withColumn("_read", F.lit(1))
        per = s.heads.join(s.weighted.select("query_id", "term", "df"), ["query_id", "term"]).select(*key, "df").join(marked, key, "left")
        return per.groupBy("query_id", "term", "df").agg(F.count("*").alias("n_blocks"), F.count("_read").alias("n_read"))


_TILE = ["query_id", "brain_id", "seq", "tile"]
_ROW = [*_TILE, "memory_id"]


class _Search:
    """The steps of one batch of queries; but for the terms' frequencies they are lazy. Scores are negative, bounds positive."""

    def __init__(self, index: BlockIndex, eligible: DataFrame, queries: DataFrame, limit: int) -> None:
        self._least: DataFrame | None = None
        self.index, self.limit, self.eligible = index, limit, eligible.select("brain_id", "memory_id")
        n_rows, n_tokens = index.counts()
        self.avg = F.lit(n_tokens / n_rows if n_rows else 1.0)
        asked = query_terms(queries)
        few_terms = asked.limit(MAX_SENT_TERMS + 1).collect()
        self.sent = sent_terms(few_terms) if len(few_terms) <= MAX_SENT_TERMS else None
        self.kind = queries.schema["query_id"].dataType
        times = {r["term"]: r["count"] for r in asked.groupBy("term").count().limit(MAX_HELD_TERMS + 1).collect()}
        self.postings: int | None = None
        if len(times) <= MAX_HELD_TERMS:
            held = F.broadcast(index.spark.createDataFrame([(t,) for t in times], "term string"))
            few = len(times) <= MAX_PUSHED_TERMS
            of = lambda df: df.where(F.col("term").isin(list(times))) if few else df.join(held, "term", "left_semi")
            known = index._df(of).collect()  # a row a term
            self.postings = sum(times[r["term"]] * r["df"] for r in known)
            df = F.broadcast(index.spark.createDataFrame(known, "term string, df bigint"))
        else:
            terms = asked.select("term").distinct()
            of = lambda df: df.join(terms, "term", "left_semi")
            df = index._df(of)
        self.blocks = of(index._read("blocks", index._live()))
        self.weighted = asked.join(df, "term").withColumn("idf", idf(F.lit(n_rows), F.col("df")))
        if self.sent is not None:
            numbers = index.spark.createDataFrame([(w, i) for i, w in enumerate(self.sent[0])], "term string, code int")
            self.numbers = F.broadcast(numbers.join(df, "term").select("term", "code", idf(F.lit(n_rows), F.col("df")).alias("idf")))
        peak = lambda p: -contribution(F.col("idf"), p["tf"], p["len"], self.avg)
        joined = self.blocks.select("term", "brain_id", "seq", "tile", "peaks").join(self.weighted, ["term", "brain_id"])
        self.heads = joined.select(*_TILE, "term", (F.array_max(F.transform("peaks", peak)) * SLACK).alias("bound"))
        self.bounds = self.heads.groupBy(*_TILE).agg(F.sum("bound").alias("bound"))

    # -------------------------------------------------------------- rows

    def _parts(self, need: DataFrame) -> DataFrame:
        """``query_id, brain_id, seq, tile, memory_id, pos, part`` of the eligible rows of blocks (``term, brain_id, seq, tile`` and a query's weight)."""
        rows = need.select(*_TILE, "pos", "idf", F.explode("docs").alias("d")).select(*_TILE, "pos", "idf", "d.*")
        there = self.index._there(rows.join(self.eligible, ["brain_id", "memory_id"], "left_semi"))
        return there.select(*_ROW, "pos", contribution(F.col("idf"), F.col("tf"), F.col("len"), self.avg).alias("part"))

    def everything(self) -> DataFrame:
        return self._parts(self.blocks.drop("peaks", "n").join(self.weighted, ["term", "brain_id"]))

    def in_tiles(self, tiles: DataFrame, *, needed: bool | None = None) -> DataFrame:
        """The blocks of the queries' terms in their ``tiles``; of terms that are needed, or not, or of all."""
        terms = self.weighted.select("query_id", "brain_id", "term", "pos", "idf")
        if needed is not None:
            terms = terms.join(self.needed().where(F.col("needed") == needed).select("query_id", "term"), ["query_id", "term"])
        return self.blocks.select("term", "brain_id", "seq", "tile", "docs").join(tiles.select(*_TILE).join(terms, ["query_id", "brain_id"]), ["term", "brain_id", "seq", "tile"])

    def best(self, parts: DataFrame) -> DataFrame:
        """The best rows, their parts summed in the order of the query's terms."""
        listed = F.array_sort(F.collect_list(F.struct("pos", "part")))
        total = F.aggregate(listed, F.lit(0.0), lambda s, x: s + x["part"])
        whole = parts.groupBy("query_id", "brain_id", "seq", "memory_id").agg(total.alias("score")).select("query_id", "memory_id", "score")
        return ranked(whole, [F.col("score").asc(), F.col("memory_id").asc()], self.limit)

    # -------------------------------------------------------------- queries that are sent to every task

    def tiles(self) -> DataFrame:
        """``brain_id, seq, tile`` of what some query's bound reaches."""
        reached = self.reached().select(*_TILE[1:]).distinct()
        few = reached.limit(MAX_SENT_TILES + 1).collect()
        return reached if len(few) > MAX_SENT_TILES else F.broadcast(self.index.spark.createDataFrame(few, reached.schema))

    def scored(self, tiles: DataFrame | None = None) -> DataFrame:
        """The best rows of all tiles or of ``tiles``; a row's postings come together once, whatever the number of queries."""
        need = self.blocks.select("term", *_TILE[1:], "docs")
        if tiles is not None:
            need = need.join(tiles, _TILE[1:], "left_semi")
        rows = need.join(self.numbers, "term").select("brain_id", "seq", "code", "idf", F.explode("docs").alias("d"))
        part = contribution(F.col("idf"), F.col("d.tf"), F.col("d.len"), self.avg)
        whole = rows.select("brain_id", "seq", "d.memory_id", F.struct("code", part.alias("part")).alias("p")).groupBy("brain_id", "memory_id", "seq").agg(F.collect_list("p").alias("parts"))
        there = self.index._there(whole.join(self.eligible, ["brain_id", "memory_id"], "left_semi"))
        shared, limit, arrow = self.index.spark.sparkContext.broadcast(self.sent[1]), self.limit, to_arrow_type(self.kind)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Scores(shared.value, limit)
            for b in batches:
                parts = b.column(2)
                row, flat = np.repeat(np.arange(b.num_rows), parts.value_lengths().to_numpy()), parts.flatten()
                best.add(b.column(0), b.column(1), row, flat.field("code").to_numpy().astype(np.int64), flat.field("part").to_numpy())
            yield best.batch(arrow)

        found = there.select("brain_id", "memory_id", "parts").mapInArrow(run, f"query_id {self.kind.simpleString()}, memory_id string, score double")
        return ranked(found, [F.col("score").asc(), F.col("memory_id").asc()], self.limit)

    # -------------------------------------------------------------- bounds

    def first(self) -> DataFrame:
        """The tiles with the largest bounds, one for each wanted row: most have a row that comes near its tile's bound."""
        return ranked(self.bounds, [F.col("bound").desc(), F.col("seq"), F.col("tile")], self.limit)

    def least(self) -> DataFrame:
        """``query_id, least``: a score that enough rows of the first tiles reach; no row where there are too few."""
        if self._least is None:
            found = self.best(self._parts(self.in_tiles(self.first()))) if self.sent is None else self.scored(self.first().select(*_TILE[1:]).distinct())
            found = found.where(F.col("rank") == self.limit).select("query_id", (-F.col("score")).alias("least"))
            few = found.limit(MAX_HELD_QUERIES + 1).collect()
            self._least = found if len(few) > MAX_HELD_QUERIES else F.broadcast(self.index.spark.createDataFrame(few, found.schema))
        return self._least

    def reached(self) -> DataFrame:
        """The tiles whose bound reaches that score."""
        return self.bounds.join(self.least(), "query_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least")))

    def needed(self) -> DataFrame:
        """``query_id, term, needed``: the terms of smallest bounds that together do not reach the score are not needed."""
        most = self.heads.groupBy("query_id", "term").agg(F.max("bound").alias("most"))
        upto = F.sum("most").over(Window.partitionBy("query_id").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        summed = most.withColumn("upto", upto * SLACK).join(self.least(), "query_id", "left")
        return summed.select("query_id", "term", (F.col("least").isNull() | (F.col("upto") >= F.col("least"))).alias("needed"))

    def _essential(self) -> DataFrame:
        return self._parts(self.in_tiles(self.reached(), needed=True))

    def candidates(self) -> DataFrame:
        """The rows that reach the score with all that the terms left out could add in their tile."""
        others = self.heads.join(self.needed().where("not needed").select("query_id", "term"), ["query_id", "term"]).groupBy(*_TILE).agg(F.sum("bound").alias("rest"))
        summed = self._essential().groupBy(*_ROW).agg((-F.sum("part") * SLACK).alias("sure"))
        joined = summed.join(others, _TILE, "left").join(self.least(), "query_id", "left")
        return joined.where(F.col("least").isNull() | (F.col("sure") + F.coalesce("rest", F.lit(0.0)) >= F.col("least"))).select(*_ROW)

    def that_matters(self) -> DataFrame:
        rows = self.candidates()
        others = self._parts(self.in_tiles(rows.select(*_TILE).distinct(), needed=False))
        return self._essential().unionByName(others).join(rows, _ROW, "left_semi")


def _blocks(post: DataFrame) -> DataFrame:
    """Blocks of ``seq, brain_id, memory_id, tile, len, term, tf``."""
    blocks = post.groupBy("seq", "term", "brain_id", "tile").agg(F.array_sort(F.collect_list(F.struct("memory_id", "tf", "len"))).alias("docs"))
    pairs = F.array_distinct(F.transform("docs", lambda d: F.struct(d["tf"].alias("tf"), d["len"].alias("len"))))
    beaten = lambda p: F.exists("_pairs", lambda q: (q["tf"] >= p["tf"]) & (q["len"] <= p["len"]) & ((q["tf"] > p["tf"]) | (q["len"] < p["len"])))
    return blocks.withColumn("_pairs", pairs).select("seq", "term", "brain_id", "tile", F.size("docs").cast("long").alias("n"), F.filter("_pairs", lambda p: ~beaten(p)).alias("peaks"), "docs")


def _ranged(df: DataFrame, parts: int, *order: str) -> DataFrame:
    return (df.repartitionByRange(parts, *order) if parts > 1 else df.coalesce(1)).sortWithinPartitions(*order)


def _in_tiles(docs: DataFrame, parts: int) -> DataFrame:
    """``docs`` with ``tile``: rows of a brain by length, a few to a tile."""
    order = ["brain_id", "len", "memory_id"]
    return _ranged(docs, parts, *order).withColumn("tile", F.shiftright(F.monotonically_increasing_id(), TILE_BITS))
