"""N-gram Jaccard join with adaptive multi-match prefixes.

Two sets with Jaccard similarity of at least t share at least ``ceil(t*n)``
shingles, so their prefixes of ``n - ceil(t*n) + m`` shingles, in an order
common to all documents, share at least m. Each document chooses its m: a
longer prefix reads more postings but demands more shared ones, and the m with
the least estimated cost of postings and verifications is taken. A pair that
shares too few prefix shingles for its sizes and its two m is never verified.

The order puts rare shingles first. Frequencies come from a sketch of fixed
size over all documents: counts of shingles and of words by hash; a shingle's
estimate is the larger of its own count above the noise and of what its words'
frequencies suggest.

Equal sets are one node from the start. Links then come in rounds. The first
ones join each posting list's members with one head of the list only, another
one each time, and unite what verification confirms; this settles groups of
copies at a cost that is linear in their size. The last round joins all members
of a list that are not yet in the same component, so no link between different
components is missed. Sets are only made again for documents that occur in some
candidate pair, once for all rounds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import among, components, discard, fresh, materialize, parallelism, sliced, text_or_empty

WORD_BITS, SHINGLE_BITS, CHUNK = 18, 20, 1 << 14
MOST_MATCHES = 8
STAR_ROUNDS = 3

# Fixed odd multipliers that keep word positions apart.
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word; only A-Z are lower-cased, only ASCII white space separates."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, text.encode("utf-8", "surrogatepass").lower().split()), np.uint64)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words; of all words, if there are fewer."""
    n = len(words)
    if not n:
        return words
    width = min(n, size)
    x = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        x = (x ^ (x >> np.uint64(29))) * _M[k % 5] + words[k : n - width + 1 + k]
    x ^= x >> np.uint64(32)
    x *= _M[3]
    return x ^ (x >> np.uint64(29))


@dataclass
class Sketch:
    """Frequencies by hash. ``cells`` are the counts of words, then those of shingles."""

    cells: np.ndarray

    def __post_init__(self) -> None:
        words, own = self.cells[: 1 << WORD_BITS], self.cells[1 << WORD_BITS :]
        total = max(int(words.sum()), 1)
        self.log_total = np.float32(np.log2(total))
        self.log_word = np.log2(np.maximum(words, 1) / total).astype(np.float32)
        noise = np.median(own)
        above = np.where(own > noise + 4 * np.sqrt(noise) + 1, own - noise, 1)
        self.log_own = np.log2(above).astype(np.float32)

    def estimate(self, own: np.ndarray, words: np.ndarray, size: int, first: np.ndarray) -> np.ndarray:
        """log2 of the estimated number of documents with each shingle, in steps of 1/4."""
        w = self.log_word[(words >> np.uint64(64 - WORD_BITS)).astype(np.int64)]
        width = min(len(words), size)
        apart = np.full(len(first), self.log_total, np.float32)
        for k in range(width):
            apart += w[first + k]
        known = self.log_own[(own >> np.uint64(64 - SHINGLE_BITS)).astype(np.int64)]
        return np.floor(np.maximum(np.maximum(apart, known), 0) * 4) / 4


def prefix(own: np.ndarray, estimate: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The chosen prefix of a set and how many of its shingles a partner must share."""
    n = len(own)
    overlap = -(-percent * n // 100)
    order = np.lexsort((own, estimate))
    longest = min(n, n - overlap + MOST_MATCHES)
    others = np.cumsum(np.exp2(estimate[order[:longest]]) - 1)  # postings of other documents
    best, chosen = None, 1
    for m in range(1, min(MOST_MATCHES, overlap) + 1):
        p = n - overlap + m
        if p > longest:
            break
        # Postings read, those of other documents met again in pairs, and sets verified: of these
        # some come from frequencies below what the sketch can tell.
        cost = p + others[p - 1] * (1 + 0.25 / m) + 0.1 * p * (n / 16) / m
        if best is None or cost < best:
            best, chosen = cost, m
    return order[: n - overlap + chosen], chosen


class JaccardJoin:
    """One join over a table; ``classes()`` is its result.

    Sets are known by a 64-bit hash; shingles too. Rows without an id are in no
    pair. Repeated rows are equal sets and so in one class.
    """

    def __init__(self, docs: DataFrame, *, size: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> None:
        self.spark = docs.sparkSession
        text = text_or_empty(text_col)
        self.src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("_text"), F.xxhash64(text).alias("th"))
        self.size, self.percent = size, percent
        self.step = log(100 / percent) * 1.0001
        self.sets: DataFrame | None = None
        self.made: list[DataFrame] = []

    # -------------------------------------------------------------- passes over the text

    def _profiles(self) -> tuple[DataFrame, Sketch]:
        size = self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["doc_id", "th", "sid", "n", "chunk", "cells"]
            words, own = np.zeros(1 << WORD_BITS, np.int64), np.zeros(1 << SHINGLE_BITS, np.int64)
            for b in sliced(batches):
                sids, sizes = [], []
                for text in b.column(1).to_pylist():
                    w = word_hashes(text)
                    s = np.unique(shingles(w, size))
                    sids.append(xxhash.xxh3_64_intdigest(s.tobytes()))
                    sizes.append(len(s))
                    np.add.at(words, (w >> np.uint64(64 - WORD_BITS)).astype(np.int64), 1)
                    own[(s >> np.uint64(64 - SHINGLE_BITS)).astype(np.int64)] += 1
                k = b.num_rows
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.array(sids, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
            cells = np.concatenate([words, own]).astype("<i8").reshape(-1, CHUNK)
            used = np.flatnonzero(cells.any(1))
            k = len(used)
            packed = [zlib.compress(cells[i].tobytes(), 1) for i in used]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(k, pa.int64()) for _ in range(4)), pa.array(used, pa.int32()), pa.array(packed, pa.binary())], names=names)

        found = materialize(self.src.mapInArrow(run, "doc_id bigint, th bigint, sid bigint, n bigint, chunk int, cells binary"), "jaccard-profiles")

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, total = None, None
            for b in batches:
                for chunk, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    more = np.frombuffer(zlib.decompress(cells), "<i8")
                    if chunk != at:
                        if at is not None:
                            yield pa.RecordBatch.from_pydict({"chunk": pa.array([at], pa.int32()), "cells": pa.array([total.tobytes()], pa.binary())})
                        at, total = chunk, more.copy()
                    else:
                        total += more
            if at is not None:
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([at], pa.int32()), "cells": pa.array([total.tobytes()], pa.binary())})

        parts = found.where("chunk is not null").select("chunk", "cells").repartition(parallelism(self.spark), "chunk").sortWithinPartitions("chunk")
        cells = np.zeros((1 << WORD_BITS) + (1 << SHINGLE_BITS), np.int64)
        for r in parts.mapInArrow(add, "chunk int, cells binary").collect():  # the sketch: a fixed size
            cells[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["cells"], "<i8")
        return found.where("chunk is null").select("doc_id", "th", "sid", "n"), Sketch(cells)

    def _postings(self, sketch: Sketch) -> DataFrame:
        size, percent, step = self.size, self.percent, self.step
        shared = self.spark.sparkContext.broadcast(sketch)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            done: set[int] = set()  # equal sets that this task has met lately; only saves work
            for b in sliced(batches):
                cols: list[list] = [[] for _ in range(7)]
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    w = word_hashes(text)
                    s, first = np.unique(shingles(w, size), return_index=True)
                    if doc is None or not len(s):
                        continue
                    sid = xxhash.xxh3_64_intdigest(s.tobytes())
                    if sid in done:
                        continue
                    if len(done) > 100_000:
                        done.clear()
                    done.add(sid)
                    often = shared.value.estimate(s, w, size, first)
                    at, m = prefix(s, often, percent)
                    k, n = len(at), len(s)
                    for c, v in zip(cols, (s[at].view(np.int64), np.full(k, int(log(n) / step)), np.full(k, sid, np.uint64).view(np.int64), np.full(k, n), np.full(k, m), np.arange(k), np.full(k, int(256 * often.mean()))), strict=True):
                        c.append(v)
                flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(f.astype(k.to_pandas_dtype()), k) for f, k in zip(flat, kinds, strict=True)], names=["token", "band", "sid", "n", "m", "at", "usual"])

        found = materialize(self.src.select("doc_id", "_text").mapInArrow(run, "token bigint, band int, sid bigint, n int, m int, at int, usual int"), "jaccard-prefixes")
        shared.destroy()
        # Two numbers a token are aggregated before the shuffle; no token's postings are gathered.
        met = found.groupBy("token").agg(F.min("sid").alias("_lo"), F.max("sid").alias("_hi")).where("_lo <> _hi").select("token")
        met = materialize(met, "jaccard-tokens")
        rows, spent = among(found, met, "token")
        postings = materialize(rows.groupBy("token", "sid").agg(*(F.max(c).alias(c) for c in ("band", "n", "m", "at", "usual"))), "jaccard-postings")
        discard(found, met, *spent)
        return postings

    def _add_sets(self, sids: DataFrame, node: DataFrame) -> None:
        """Have ``sid, items`` of the given sets in ``self.sets``, each from one document."""
        if self.sets is not None:
            sids = sids.join(self.sets.select("sid"), "sid", "left_anti")
        sids = materialize(sids, "jaccard-sids")
        if not sids.isEmpty():
            more = self._made(sids, node)
            self.made.append(more)
            self.sets = reduce(DataFrame.unionByName, self.made)
        discard(sids)

    def _made(self, sids: DataFrame, node: DataFrame) -> DataFrame:
        size = self.size
        wanted = materialize(node.join(sids, "sid").select("doc_id"), "jaccard-wanted")
        near, spent = among(self.src, wanted, "doc_id")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in sliced(batches):
                sets = [s for t in b.column(0).to_pylist() if len(s := np.unique(shingles(word_hashes(t), size)))]
                sid = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(sid, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))], names=["sid", "items"])

        found = near.select("_text").mapInArrow(run, "sid bigint, items array<bigint>")
        sets = materialize(found.join(sids, "sid", "left_semi").dropDuplicates(["sid"]), "jaccard-sets")
        discard(wanted, *spent)
        return sets

    # -------------------------------------------------------------- rounds

    def _labelled(self, df: DataFrame, united: DataFrame | None) -> DataFrame:
        if united is None:
            return df.withColumn("label", F.col("sid"))
        return df.join(united.withColumnRenamed("id", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))

    def _unsettled(self, postings: DataFrame, united: DataFrame | None) -> DataFrame:
        """The postings of lists with more than one component, with each one's label."""
        labelled = self._labelled(postings, united)
        if united is None:
            return labelled
        mixed = labelled.groupBy("token").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).where("_lo <> _hi").select("token")
        return materialize(labelled.join(mixed, "token", "left_semi"), "jaccard-unsettled")

    def _verified(self, pairs: DataFrame, node: DataFrame) -> DataFrame:
        """The pairs (x, y) whose similarity reaches the threshold."""
        pairs = materialize(pairs, "jaccard-pairs")
        sids = pairs.select(F.explode(F.array("x", "y")).alias("sid")).distinct()
        self._add_sets(sids, node)
        sets = self.sets
        if sets is None:  # no pairs
            return pairs
        joined = pairs.join(sets.select(F.col("sid").alias("x"), F.col("items").alias("_a")), "x").join(sets.select(F.col("sid").alias("y"), F.col("items").alias("_b")), "y")
        both = F.size(F.array_intersect("_a", "_b")).cast("long")
        ok = joined.where(both * 100 >= (F.size("_a") + F.size("_b") - both) * self.percent)
        links = materialize(ok.select("x", "y"), "jaccard-links")
        discard(pairs)
        return links

    def _matched(self, hits: DataFrame) -> DataFrame:
        """From rows ``x, y, need`` for each shared prefix shingle: pairs with enough of them."""
        return hits.groupBy("x", "y").agg(F.count("*").alias("c"), F.min("need").alias("need")).where("c >= need").select("x", "y")

    def _overlap(self, n: str, other: str) -> str:
        """SQL for what similar sets of these sizes share at least."""
        return f"ceil(({n} + {other}) * {self.percent} / {100 + self.percent} - 1e-9)"

    def _sized(self, n: str, other: str) -> str:
        return f"least({n}, {other}) * 100 >= greatest({n}, {other}) * {self.percent}"

    def _star(self, lists: DataFrame, salt: int) -> DataFrame:
        """Each posting of a list with the list's head.

        The first head is the set whose shingles are the most usual ones: of near
        copies it is the one with the fewest edits of its own. Later heads are
        those whose salted hash is least. Of the shingles that similar sets share,
        at most as many as are outside of the prefix that ends first can be
        missing from the prefixes' intersection.
        """
        rows = lists.withColumn("o", F.expr(f"ceil(n * {self.percent} / 100 - 1e-9) - m"))
        rank = -F.col("usual") if salt == 0 else F.lit(0)
        head = rows.groupBy("token", "band").agg(F.min(F.struct(rank.alias("first"), F.xxhash64("sid", F.lit(salt)).alias("by"), "sid", "n", "o", "label")).alias("h"))
        met = rows.join(head, ["token", "band"]).where(f"label <> h.label and {self._sized('n', 'h.n')}")
        return met.selectExpr("sid x", "h.sid y", f"{self._overlap('n', 'h.n')} - greatest(o, h.o) need")

    def _all(self, lists: DataFrame) -> DataFrame:
        """All pairs of postings of a list in different components, of sizes that can be similar.

        For two given sizes the shared part is known to be larger than for one
        size alone, so of either prefix only as much is looked at as the pair
        needs for its smaller m. What a set shares with many others, as copies
        do, comes last in the order and is mostly outside of that.
        """
        rows = lists.select("token", "band", "sid", "n", "m", "at", "label")
        other = rows.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1)))
        need = f"{self._overlap('l.n', 'r.n')} - least(l.m, r.m)"
        # With a shared shingle at these places, no more can be shared before and after it.
        most = "least(l.at, r.at) + least(l.n - l.at, r.n - r.at)"
        on = f"""l.token = r.token and l.band = r.band and l.label <> r.label and (r.n < l.n or (r.n = l.n and r.sid < l.sid))
            and {self._sized("l.n", "r.n")} and l.at < l.n - ({need}) and r.at < r.n - ({need})
            and {most} >= {self._overlap("l.n", "r.n")}"""
        return rows.alias("l").join(other.alias("r"), F.expr(on)).selectExpr("l.sid x", "r.sid y", "least(l.m, r.m) need")

    def labelled(self) -> DataFrame:
        """``doc_id, th, n, label``, one row per input row: ``label`` is the class, ``th`` a hash of the text."""
        profiles, sketch = self._profiles()
        node = materialize(profiles.where("n > 0 and doc_id is not null").groupBy("sid").agg(F.min("doc_id").alias("doc_id")), "jaccard-nodes")
        postings = self._postings(sketch)
        united: DataFrame | None = None
        rounds, last = 0, False
        while not (unsettled := self._unsettled(postings, united)).isEmpty():
            new = self._verified(self._matched(self._all(unsettled) if last else self._star(unsettled, rounds)), node)
            if united is not None:
                discard(unsettled)
            more = not new.isEmpty()
            if more:
                # Of the links so far their classes are enough.
                known = new if united is None else new.unionByName(united.select(F.col("id").alias("x"), F.col("label").alias("y")))
                wider = components(known)
                discard(new, *([united] if united is not None else []))
                united = wider
            if last:
                break
            rounds += 1
            last = rounds == STAR_ROUNDS or not more
        discard(postings, node, *self.made)
        linked = (F.col("n") > 0) & F.col("doc_id").isNotNull()
        if united is None:
            return profiles.withColumn("label", F.when(linked, F.col("sid")))
        to = united.select(F.col("id").alias("_sid"), "label")
        return profiles.join(to, (F.col("sid") == F.col("_sid")) & linked, "left").select("doc_id", "th", "n", F.when(linked, F.coalesce("label", "sid")).alias("label"))

    def classes(self) -> DataFrame:
        """``doc_id, n_shingles, component_id``, one row per input row."""
        rows = materialize(self.labelled(), "jaccard-labelled")
        least = materialize(rows.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("_least")), "jaccard-least")
        return rows.join(least, "label", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("_least", "doc_id").alias("component_id"))


def jaccard_classes(docs: DataFrame, *, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id``: connected classes of documents with similar shingle sets.

    Two documents are linked when ``100 * shared >= percent * all`` of their
    distinct shingles of ``size`` words (fewer words: all of them as one).
    ``component_id`` is the smallest id that links reach, its own included. A null
    or empty text has no shingles and is its own class; a null id has a null
    class. Repeated rows are answered each; other columns are not read.
    """
    return JaccardJoin(docs, size=size, percent=percent, id_col=id_col, text_col=text_col).classes()


def keep_one_of_each(docs: DataFrame, *, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class: of smallest id, and of several texts with that id the one of least hash.

    Of rows with the same id and text one stays; rows of one id with texts of
    different classes are judged apart. Documents without words are a class each
    and rows without an id in none; they stay. Columns may have any names.
    """
    rows = materialize(JaccardJoin(docs, size=size, percent=percent, id_col=id_col, text_col=text_col).labelled().where("doc_id is not null"), "jaccard-labelled")
    first = rows.where("label is not null").groupBy("label").agg(F.min(F.struct("doc_id", "th")).alias("y")).select("y.doc_id", "y.th")
    kept = materialize(first.unionByName(rows.where("label is null").select("doc_id", "th").distinct()), "jaccard-kept")
    doc, th, to, of = (fresh(c, docs.columns) for c in ("_doc", "_th", "_to", "_of"))
    keyed = docs.withColumns({doc: F.col(id_col).cast("long"), th: F.xxhash64(text_or_empty(text_col))})
    named = kept.select(F.col("doc_id").alias(to), F.col("th").alias(of))
    one = keyed.join(named, (F.col(doc) == F.col(to)) & (F.col(th) == F.col(of)), "left_semi")
    if not rows.groupBy("doc_id", "th").count().where("count > 1").isEmpty():
        one = one.dropDuplicates([doc, th])
    discard(rows)
    return one.select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))


def brute_force(texts: dict[int, str | None], size: int, percent: int) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, component), from the words themselves; for tests."""
    sets = {}
    for d, t in texts.items():
        w = (t or "").encode("utf-8", "surrogatepass").lower().split()
        sets[d] = {tuple(w[i : i + size]) for i in range(max(len(w) - size, 0) + 1)} if w else set()
    up = {d: d for d in texts}

    def root(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small and small * 100 >= large * percent:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (small + large - both):
                    x, y = sorted((root(a), root(b)))
                    up[y] = x
    return {d: (len(sets[d]), root(d)) for d in texts}
