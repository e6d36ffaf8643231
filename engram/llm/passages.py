"""Substring dedup by compact windows.

A text is the sequence of its five-word shingles. Under a hash function, the
Cartesian tree over the shingles' hashes has a node for every shingle; all
subsequences that contain it and lie in its subtree's span have it as their
min-hash, and so form one compact window. Only nodes whose span holds a passage
of the least length matter, about two in that length. They are found without
building the tree: the minima of all runs of the least length change only where
one such node gives way to the next.

Windows with the same signature are a group, and each window of a group is
joined with the group's first, so cost is linear in group size. For a pair of
documents the windows' aligned intervals are joined: where intervals of
``enough`` functions overlap there is a candidate, which is verified on the
words of both sides by exact Jaccard similarity.

Where this leaves windows unconfirmed, their group may have parts that its
first does not resemble, as boilerplate has. All windows of such groups get
signatures that say more, and are joined with the first of those:

- level 0: the minimum of a run of the least length, under each function;
- level 1: the minima of the run's two halves, under each function, and hashes
  of stretches around the first function's minimum that are almost a passage;
- level 2: hashes of whole passages around those stretches.

An exact repeat has the same first minimum in both places; the stretches are
laid so that one of them lies in the repeat, whatever its ends, and the passages
so that one of them is within it. So it meets a first that it equals at level 2
at the latest, and only words at the edges of confirmed passages may be left. A
near copy is found with a probability: at the least similarity, 0.97 by level 0
where its group's first is no stranger, 0.98 by level 1 where it is.

Texts are read once: their words' 32-bit hashes are written down beside the
windows, and every later step reads those.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import among, discard, materialize, sliced, text_or_empty
from engram.llm.jaccard import shingles

SHINGLE = 5
#: At level 1, the stretches around a minimum: how many, and how much each is shorter than a passage.
STRETCHES = 8
_STRETCH, _PASSAGE = 100, 200  # kinds of signatures; below are the functions' numbers
_BLOCK = 1 << 18  # words that are worked on together, at least


def word_hashes(text: str) -> np.ndarray:
    """A 32-bit hash of each word; five of them in a row make a shingle."""
    return np.fromiter(map(xxhash.xxh32_intdigest, text.encode("utf-8", "surrogatepass").lower().split()), np.uint32)


def _functions(k: int) -> list[np.uint64]:
    rng = np.random.default_rng(20)
    return [np.uint64(x) for x in rng.integers(1, 1 << 63, k, dtype=np.int64)]


def _permuted(s: np.ndarray, key: np.uint64) -> np.ndarray:
    """A bijection of 64-bit numbers for each key: equal results mean equal shingles."""
    x = (s ^ key) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _run_minima(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` items, by block-wise prefix and suffix minima."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def compact_windows(x: np.ndarray, width: int, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimum, its position, first, last) of each compact window that spans ``width`` items.

    Only runs that begin at ``starts`` count; without it, all do. The position
    is the first one in the window's first run.
    """
    if starts is None:
        starts = np.arange(max(len(x) - width + 1, 0))
    if not len(starts):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    low = _run_minima(x, width)[starts]
    first, last = _runs(starts, low)
    return low[first], _place(x, starts[first], width), starts[first], starts[last] + width - 1


def _runs(starts: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each stretch of neighbouring starts with one value."""
    new = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (np.diff(starts) > 1)])
    return new, np.r_[new[1:], len(starts)] - 1


def _place(x: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Where the least of the ``width`` items from ``first`` on is."""
    return first + np.concatenate([np.argmin(x[part[:, None] + np.arange(width)], 1) for part in np.array_split(first, len(first) // 50_000 + 1)])


def candidates(hits: list[tuple[int, int, int, int, int, int, int]], enough: int) -> list[tuple[int, int, int, int]]:
    """From hits (function, x centre, x first, x last, y centre, y first, y last) of two texts:

    (x first, x last, y first, y last) of each stretch that aligned intervals of
    at least ``enough`` functions cover together.
    """
    spans = []
    for f, xc, xa, xb, yc, ya, yb in hits:
        shift = xc - yc
        spans.append((max(xa, ya + shift), min(xb, yb + shift), shift, f))
    spans.sort()
    out, group = [], []
    reach = -1
    for s in [*spans, (1 << 62, 1 << 62, 0, -1)]:
        if group and s[0] > reach:
            if len({g[3] for g in group}) >= enough:
                out.append((group[0][0], reach, min(g[0] - g[2] for g in group), max(g[1] - g[2] for g in group)))
            group, reach = [], -1
        group.append(s)
        reach = max(reach, s[1])
    return out


def verify(a: np.ndarray, b: np.ndarray, least: int, percent: int) -> list[tuple[int, int, int, int, float]]:
    """Near-equal stretches of two shingle sequences: (a first, a end, b first, b end, similarity).

    Shared shingles of ``a`` that are parted by less than two edits' worth of
    shingles are taken together. A stretch that is not similar enough is divided
    at its weakest seam, where most shingles are missing on either side, and its
    parts are tried again. Stretches shorter than ``least`` take in unshared
    shingles at their edges, on both sides alike, and these count.
    """
    order = np.argsort(b, kind="stable")
    ranked = b[order]
    first, end = np.searchsorted(ranked, a, "left"), np.searchsorted(ranked, a, "right")
    where = np.flatnonzero(first < end)
    if not len(where):
        return []
    places = order[first[where]]
    for i in np.flatnonzero(end[where] - first[where] > 1).tolist():  # several places: the one that best goes on from the last
        own = order[first[where[i]] : end[where[i]]]
        want = places[i - 1] + where[i] - where[i - 1] if i else own[0]
        k = min(int(np.searchsorted(own, want)), len(own) - 1)
        places[i] = own[k - 1] if k and want - own[k - 1] < abs(own[k] - want) else own[k]
    step = np.diff(where)
    seams = np.maximum(step - 1, np.abs(np.diff(places) - step))
    cuts = [0, *(np.flatnonzero(step > 2 * SHINGLE + 1) + 1).tolist(), len(where)]
    out = []
    todo = list(zip(cuts, cuts[1:], strict=False))
    while todo:
        i, j = todo.pop()
        s, e = int(where[i]), int(where[j - 1])
        inner = seams[i : j - 1]
        need = least - (e - s + 1)
        if need > 0 and (j - i) * 100 < percent * (e - s + 1):
            continue
        lo, hi = _span(places[i:j], e - s + 1)
        left, right = _edges(need, min(s, lo), min(len(a) - 1 - e, len(b) - 1 - hi))
        if e - s + 1 + left + right >= least:
            x, y = np.unique(a[s - left : e + 1 + right]), np.unique(b[lo - left : hi + 1 + right])
            both = len(np.intersect1d(x, y, assume_unique=True))
            union = len(x) + len(y) - both
            # A passage that ``a`` has twice is found twice, not as one that is much longer than its copy.
            sizes = sorted((e - s + 1, hi - lo + 1))
            twice = sizes[0] * 100 < percent * sizes[1] and len(inner) and inner.max() >= least // 2
            if both * 100 >= percent * union and not twice:
                out.append((s - left, e + 1 + right, lo - left, hi + 1 + right, both / union))
                continue
        if len(inner) and inner.max() > 0:
            weakest = np.flatnonzero(inner == inner.max())
            k = i + 1 + int(weakest[len(weakest) // 2])
            todo += [(i, k), (k, j)]
    return sorted(out)


def _edges(need: int, left: int, right: int) -> tuple[int, int]:
    """How many of ``need`` shingles to take on the left and on the right, of those that there are."""
    if need <= 0:
        return 0, 0
    first = min(left, max(need - right, need // 2))
    return first, min(right, need - first)


def _span(places: np.ndarray, length: int) -> tuple[int, int]:
    """First and last of the matched places that lie within one passage's length of their median."""
    middle = np.sort(places)[len(places) // 2]
    near = places[np.abs(places - middle) <= 0.75 * length + 2 * SHINGLE]
    return int(near.min()), int(near.max())

_WINDOW = "v bigint, doc bigint, t bigint, k int, c int, a int, b int"
_NAMES = [x.split()[0] for x in _WINDOW.split(", ")]
_TYPES = (np.int64, np.int64, np.int64, np.int32, np.int32, np.int32, np.int32)


def repeated_passages(
    docs: DataFrame,
    *,
    least_words: int = 50,
    percent: int = 80,
    functions: int = 4,
    enough: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, start_word, end_word, other_id, other_start, other_end, similarity``.

    A row for each passage of at least ``least_words`` words of a document that
    is a near copy (``percent`` of five-word shingles) of one in an earlier
    document; ends are exclusive, words are parted by ASCII white space and
    compared with A-Z lower-cased. Documents are ordered by id. Rows with one id
    and different texts are ordered by a hash of the text, and a passage of one
    may be a copy of the other's, so that both ids are equal. Of several copies
    in one earlier document the first one is given, and of several documents the
    earliest. Null and shorter texts and rows without an id have no rows; an
    equal row is found once; other columns are not read, whatever their names.
    """
    keys = _functions(functions)
    width = least_words - SHINGLE + 1
    src = _texts(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [b.column(i).to_numpy() for i in (0, 1)]
            at, seqs = [], []
            for i in range(b.num_rows):
                w = word_hashes(b.column(2)[i].as_py())
                if len(w) >= least_words:
                    at.append(i)
                    seqs.append(w)
                if seqs and (sum(map(len, seqs)) >= _BLOCK or i == b.num_rows - 1):
                    texts = Texts(*(x[at] for x in ids), np.concatenate(seqs), np.array([len(x) for x in seqs]))
                    at, seqs = [], []
                    starts = texts.starts(width)
                    for f, key in enumerate(keys):
                        value, centre, first, last = compact_windows(_permuted(texts.shingles, key), width, starts)
                        yield _batch(texts, f, value, centre, first, last, words=f == 0)

    parts = materialize(src.mapInArrow(run, f"{_WINDOW}, words array<int>"), "passage-parts")
    texts = parts.where("words is not null").select("doc", "t", "words")
    windows = parts.where("words is null").drop("words").withColumn("open", F.lit(True))
    found: list[DataFrame] = []
    for level in range(3):
        shared, links = _linked(windows)
        found.append(_confirmed(texts, links, width, percent, 1 if level else enough))
        if level:
            discard(windows)
        if level < 2:  # at level 2 only stretches are divided further
            rest = _unsettled(*(df.where(F.col("k") >= level * _STRETCH) for df in (shared, links)), found)
            windows = _finer(texts, rest, width, keys, level + 1)
            discard(rest)
        discard(shared, links)
    discard(parts)
    best = reduce(DataFrame.unionByName, found).groupBy("doc", "t", "xs", "xe").agg(F.min(F.struct("other", "ot", "ys", "ye", "similarity")).alias("y"))
    return best.selectExpr(
        "doc doc_id", "cast(xs as bigint) start_word", f"cast(xe + {SHINGLE - 1} as bigint) end_word", "y.other other_id", "cast(y.ys as bigint) other_start", f"cast(y.ye + {SHINGLE - 1} as bigint) other_end", "y.similarity similarity"
    )


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc, t, text``; ``t`` is 0 but for ids that have several texts."""
    src = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), text_or_empty(text_col).alias("text"))
    th = F.xxhash64("text")
    several = src.select("doc", th.alias("t")).groupBy("doc").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo <> hi").select("doc", F.lit(True).alias("many"))
    several = materialize(several, "passage-ids")
    if several.isEmpty():
        return src.select("doc", F.lit(0).cast("long").alias("t"), "text")
    return src.join(several, "doc", "left").select("doc", F.when(F.col("many"), th).otherwise(F.lit(0)).alias("t"), "text")


class Texts:
    """Some texts' words, one after the other, so that they can be worked on together."""

    def __init__(self, doc: np.ndarray, t: np.ndarray, words: np.ndarray, sizes: np.ndarray) -> None:
        self.doc, self.t, self.words = doc, t, words
        self.ends = np.cumsum(sizes)
        self.begin = self.ends - sizes
        self.of = np.repeat(np.arange(len(sizes)), sizes)
        self.shingles = shingles(words.astype(np.uint64), SHINGLE)

    def starts(self, width: int) -> np.ndarray:
        """Where the runs of ``width`` shingles begin that lie in one text."""
        n = max(len(self.words) - width - SHINGLE + 2, 0)
        return np.flatnonzero(self.of[:n] == self.of[width + SHINGLE - 2 :][:n])


def _batch(texts: Texts, kind: int | np.ndarray, value: np.ndarray, centre: np.ndarray, first: np.ndarray, last: np.ndarray, *, words: bool = False, is_open: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows of windows, at their places in the texts; then a row for each text with its words' hashes.

    Signatures of different kinds are kept apart by a bijection for each kind.
    """
    n, m = len(value), len(texts.doc) if words else 0
    kind = np.broadcast_to(np.asarray(kind), n)
    own = (value ^ ((kind + 1).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))).view(np.int64)
    i = texts.of[centre]
    cols = [own, texts.doc[i], texts.t[i], kind, *(x - texts.begin[i] for x in (centre, first, last))]
    tail = [0, texts.doc, texts.t, 0, 0, 0, 0]
    arrays = [pa.array(np.concatenate([c, np.broadcast_to(x, len(texts.doc))[:m]]).astype(k)) for c, x, k in zip(cols, tail, _TYPES, strict=True)]
    if is_open is not None:
        return pa.RecordBatch.from_arrays([*arrays, pa.array(is_open)], names=[*_NAMES, "open"])
    ends = np.concatenate([np.zeros(n + 1), texts.ends[:m]]).astype(np.int32)
    flat = texts.words.view(np.int32) if words else np.zeros(0, np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.arange(n + m + 1) < n), pa.array(flat, pa.int32()))
    return pa.RecordBatch.from_arrays([*arrays, lists], names=[*_NAMES, "words"])


def _linked(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The windows of groups with several texts, and each open one with its group's first.

    First are the least ids of the signatures, aggregated before the shuffle;
    then only windows of shared signatures are shuffled, in joins that can be
    split where one signature has very many windows.
    """
    ends = windows.groupBy("v").agg(F.min("doc").alias("doc"), F.max("doc").alias("_hi"), F.min("t").alias("_t0"), F.max("t").alias("_t1"))
    keys = materialize(ends.where("doc <> _hi or _t0 <> _t1").select("v", F.col("doc").alias("lo")), "passage-keys")
    rows, spent = among(windows, keys, "v")
    shared = materialize(rows, "passage-shared")
    first = shared.join(keys.withColumnRenamed("lo", "doc"), ["v", "doc"], "left_semi").groupBy("v").agg(F.min(F.struct("doc", "t", "c", "a", "b")).alias("y"))
    links = shared.where("open").join(first, "v").where("doc <> y.doc or t <> y.t").selectExpr("v", "k", "doc x", "t xt", "c xc", "a xa", "b xb", "y.doc y", "y.t yt", "y.c yc", "y.a ya", "y.b yb").distinct()
    links = materialize(links, "passage-links")
    discard(keys, *spent)
    return shared, links


def _unsettled(shared: DataFrame, links: DataFrame, found: list[DataFrame]) -> DataFrame:
    """``doc, t, spans (c, a, b, k, open)``: all windows of the groups with an open one.

    Open are windows whose minimum lies in no confirmed passage of their document.
    """
    held = reduce(DataFrame.unionByName, found).groupBy(F.col("doc").alias("x"), F.col("t").alias("xt")).agg(F.collect_set(F.struct("xs", "xe")).alias("_held"))
    inside = F.exists("_held", lambda h: (h["xs"] <= F.col("xc")) & (F.col("xc") < h["xe"]))
    left = links.join(held, ["x", "xt"], "left").where(~F.coalesce(inside, F.lit(False))).selectExpr("v", "x doc", "xt t", "xc c", "xa a", "xb b", "k", "true open")
    left = materialize(left, "passage-open")
    groups = materialize(left.select("v").distinct(), "passage-groups")
    others, spent = among(shared, groups, "v")
    windows = left.drop("v").unionByName(others.selectExpr("doc", "t", "c", "a", "b", "k", "false open"))
    spans = windows.groupBy("doc", "t", "c", "a", "b", "k").agg(F.max("open").alias("open")).groupBy("doc", "t").agg(F.collect_list(F.struct("c", "a", "b", "k", "open")).alias("spans"))
    rest = materialize(spans, "passage-rest")
    discard(left, groups, *spent)
    return rest


def _inside(n: int, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    edges = np.bincount(first, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(edges[:n]) > 0


_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Runs:
    """Hashes of any stretches of a sequence, from sums of its items' multiples."""

    def __init__(self, s: np.ndarray) -> None:
        n = len(s)
        self.sums = np.r_[np.uint64(0), np.cumsum((s ^ (s >> np.uint64(31))) * _powers(_BASE, n), dtype=np.uint64)]
        self.back = _powers(_INVERSE, n + 1)

    def hash(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[first]) * self.back[first]
        x ^= x >> np.uint64(32)
        return x * np.uint64(0xD6E8FEB86659FD93)


def halves(s: np.ndarray, width: int, starts: np.ndarray, key: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signature, place of the first half's minimum, first, last) of the runs that begin at ``starts``.

    Neighbouring runs with equal minima in both halves are one window.
    """
    if not len(starts):
        return compact_windows(s, width, starts)
    x, h = _permuted(s, key), width // 2
    sign = _run_minima(x, h)[starts] * np.uint64(0x9E3779B97F4A7C15) ^ (_run_minima(x, width - h)[starts + h] >> np.uint64(1))
    first, last = _runs(starts, sign)
    return sign[first], _place(x, starts[first], h), starts[first], starts[last] + width - 1


def stretches(width: int) -> list[tuple[int, int]]:
    """(shingles before, after) a minimum: of any run of ``width`` around it, at least one stretch is a part."""
    step = -(-width // STRETCHES)
    return [(max(width - step - r, 0), r) for r in range(0, width, step)]


def _finer(texts: DataFrame, rest: DataFrame, width: int, keys: list[np.uint64], level: int) -> DataFrame:
    """The windows of ``rest`` by the signatures of ``level``, open or not."""
    reach = width + 2 * SHINGLE
    around = stretches(width)
    if level == 1:
        kinds = [(0, _STRETCH + j, before, after) for j, (before, after) in enumerate(around)]
    else:
        kinds = [(_STRETCH + j, _PASSAGE + j * width + e, before + e, width - 1 - before - e) for j, (before, after) in enumerate(around) for e in range(width - before - after)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 512):
            sizes = b.column(2).value_lengths().to_numpy()
            texts = Texts(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).flatten().to_numpy().view(np.uint32), sizes)
            n = len(texts.shingles)
            spans = b.column(3).flatten()
            c, lo, hi, kind, is_open = (spans.field(i).to_numpy(zero_copy_only=False) for i in range(5))
            i = np.repeat(np.arange(b.num_rows), b.column(3).value_lengths().to_numpy())
            c, lo, hi = (x + texts.begin[i] for x in (c, lo, hi))
            hi = np.minimum(hi, texts.ends[i] - SHINGLE)
            if level == 1:
                mine = _inside(n, lo[is_open], hi[is_open] - width + 2)
                covered = np.flatnonzero(_inside(n, lo, hi - width + 2))
                for f, key in enumerate(keys):
                    value, centre, first, last = halves(texts.shingles, width, covered, key)
                    yield _batch(texts, f, value, centre, first, last, is_open=mine[first] | mine[last - width + 1])
            hashes = Runs(texts.shingles)
            for of, to, before, after in kinds:
                at = np.flatnonzero((kind == of) & (c - before >= lo) & (c + after <= hi))
                x, own = c[at], i[at]
                first, last = np.maximum(x - reach, texts.begin[own]), np.minimum(x + reach, texts.ends[own] - SHINGLE)
                yield _batch(texts, to, hashes.hash(x - before, x + after + 1), x, first, last, is_open=is_open[at])

    near, spent = among(texts, rest, "doc", "t")
    out = materialize(near.join(rest, ["doc", "t"]).select("doc", "t", "words", "spans").mapInArrow(run, f"{_WINDOW}, open boolean"), "passage-windows")
    discard(*spent)
    return out


def _confirmed(texts: DataFrame, links: DataFrame, width: int, percent: int, enough: int) -> DataFrame:
    """``doc, t, xs, xe, other, ot, ys, ye, similarity`` in shingle positions, written."""

    def intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows = []
            for x, xt, y, yt, hits in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                rows += [(x, xt, y, yt, *c) for c in candidates([tuple(h.values()) for h in hits], enough)]
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.int64()] * 4 + [pa.int32()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["x", "xt", "y", "yt", "xs", "xe", "ys", "ye"])

    hits = links.groupBy("x", "xt", "y", "yt").agg(F.collect_list(F.struct("k", "xc", "xa", "xb", "yc", "ya", "yb")).alias("hits"))
    pairs = materialize(hits.mapInArrow(intervals, "x bigint, xt bigint, y bigint, yt bigint, xs int, xe int, ys int, ye int").withColumn("pair", F.monotonically_increasing_id()), "passage-pairs")
    sides = pairs.select("pair", F.explode(F.array(*(F.struct(F.lit(k == "y").alias("other"), F.col(k).alias("doc"), F.col(f"{k}t").alias("t"), F.col(f"{k}s").alias("s"), F.col(f"{k}e").alias("e")) for k in "xy"))).alias("_")).select("pair", "_.*")
    wanted = materialize(sides.select("doc", "t").distinct(), "passage-docs")
    near, spent = among(texts, wanted, "doc", "t")
    words = F.slice("words", F.col("s") + 1, F.col("e") - F.col("s") + SHINGLE)
    cut = sides.join(near, ["doc", "t"]).select("pair", "other", "doc", "t", "s", words.alias("words"))
    one = lambda other: F.first(F.when(F.col("other") == other, F.struct("doc", "t", "s", "words")), ignorenulls=True)
    two = cut.groupBy("pair").agg(one(False).alias("x"), one(True).alias("y")).selectExpr("x.doc", "x.t", "x.s xs", "x.words xw", "y.doc other", "y.t ot", "y.s ys", "y.words yw")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows = []
            for i, (doc, t, xs, other, ot, ys) in enumerate(zip(*(b.column(j).to_pylist() for j in (0, 1, 2, 4, 5, 6)), strict=True)):
                x, y = (shingles(np.asarray(b.column(j)[i].values).view(np.uint32).astype(np.uint64), SHINGLE) for j in (3, 7))
                if len(x) and len(y):
                    rows += [(doc, t, xs + s, xs + e, other, ot, ys + lo, ys + hi, sim) for s, e, lo, hi, sim in verify(x, y, width, percent)]
            cols = list(zip(*rows, strict=True)) or [[]] * 9
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc", "t", "xs", "xe", "other", "ot", "ys", "ye", "similarity"])

    found = materialize(two.mapInArrow(check, "doc bigint, t bigint, xs int, xe int, other bigint, ot bigint, ys int, ye int, similarity double"), "passages")
    discard(pairs, wanted, *spent)
    return found
