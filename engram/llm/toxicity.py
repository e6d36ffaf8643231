"""Toxicity by compression distance.

Two zstandard dictionaries are trained, each on text of its own: one on windows
of ordinary text, one on stretches of toxic text. A window is compressed with
the ordinary dictionary and with the toxic one beside it; what the toxic one
saves is the window's distance. Toxic documents are ordinary prose for the most
part, and a dictionary of their whole windows would hold that prose: the
stretches it is trained on are those whose byte 6-grams occur in far more toxic
than ordinary documents.

All windows of a document are compared with thresholds that are calibrated on
labelled rows that trained no dictionary: savings that only given shares of
ordinary windows pass. How many and which part of its windows pass each
threshold, and the largest and mean saving, are weighed by a logistic
calibration on the same rows.

The fit is one task's work on a bounded sample (``Bounds``) of the labelled
rows; the driver gets the model alone, some 100 KB, and broadcasts it. Scoring
is one pass over the text without a shuffle.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import sliced, text_or_empty

WINDOW, STRIDE = 64, 32  # bytes
LEVEL = 3
PASSING = (0.02, 0.01, 0.005, 0.001, 0.0001)  # shares of ordinary windows above each threshold
GRAM, BITS = 6, 20
_BLOCK = 1 << 22


@dataclass(frozen=True)
class Bounds:
    """What a fit may read, and the sizes of the dictionaries.

    Rows of each label are drawn by a hash of their ids up to the rows' and the
    bytes' bound; each is read whole, and one that does not fit is left out whole.
    """

    toxic_rows: int = 3000
    ordinary_rows: int = 6000
    sample_bytes: int = 1 << 26
    ordinary_bytes: int = 65_536
    toxic_bytes: int = 2048
    ordinary_windows: int = 80_000


def window_starts(n: int) -> np.ndarray:
    return np.arange(0, max(n - WINDOW + STRIDE, 1), STRIDE, dtype=np.int64)


def _compressor(content: bytes) -> zs.ZstdCompressor:
    made = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(level=LEVEL)
    return zs.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False)


def _train(size: int, samples: list[bytes]) -> bytes:
    try:
        return zs.train_dictionary(size, samples).as_bytes()
    except zs.ZstdError:  # too few samples to train on: their own bytes are the dictionary
        return b"".join(dict.fromkeys(samples))[-size:]


def _grams(data: bytes) -> np.ndarray:
    """A BITS-bit hash of each GRAM bytes."""
    a = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = len(a) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + a[k : n + k] + np.uint64(1)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _stretches(data: bytes, telling: np.ndarray) -> list[bytes]:
    """Maximal runs of bytes covered by telling grams."""
    at = np.flatnonzero(telling[g]) if len(g := _grams(data)) else []
    if not len(at):
        return []
    covered = np.zeros(len(data) + 2, np.int32)
    covered[at] += 1
    np.add.at(covered, at + GRAM, -1)
    edges = np.diff(np.concatenate([[0], (np.cumsum(covered) > 0).astype(np.int8)]))
    return [data[a:b] for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True)]


def _drawn_windows(blobs: list[bytes], most: int, rng: np.random.Generator) -> list[bytes]:
    """At most ``most`` of all windows, in an order drawn at random; only these are copied."""
    ends = np.cumsum([len(window_starts(len(b))) for b in blobs])
    drawn = rng.permutation(int(ends[-1]))[:most]
    at = np.searchsorted(ends, drawn, side="right")
    begin = (drawn - np.where(at > 0, ends[at - 1], 0)) * STRIDE
    return [blobs[i][s : s + WINDOW] for i, s in zip(at.tolist(), begin.tolist(), strict=True)]


@dataclass
class Model:
    ordinary: bytes = b" " * 8
    toxic: bytes = b""
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))
    thresholds: tuple[float, ...] = ()
    _pair: tuple | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_pair": None}

    def savings(self, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes saved by the toxic dictionary in each window, and where each text's windows begin."""
        if self._pair is None:
            self._pair = (_compressor(self.ordinary), _compressor(self.ordinary + self.toxic))
        offsets, lengths, first, base, n = [], [], [], 0, 0
        for b in blobs:
            s = window_starts(len(b))
            first.append(n)
            n += len(s)
            offsets.append(s + base)
            lengths.append(np.minimum(WINDOW, len(b) - s))
            base += len(b)
        off, size = np.concatenate(offsets), np.concatenate(lengths)
        full = np.flatnonzero(size > 0)  # an empty text's window saves nothing
        out = np.zeros(n, np.float32)
        if len(full):
            segments = np.stack([off[full], size[full]], 1).astype("<u8").tobytes()
            plain, both = (c.multi_compress_to_buffer(zs.BufferWithSegments(b"".join(blobs), segments)) for c in self._pair)
            out[full] = np.fromiter((len(plain[i]) - len(both[i]) for i in range(len(full))), np.float32, len(full))
        return out, np.array(first)

    def features(self, texts: list[str]) -> np.ndarray:
        rows, blobs, size = [], [], 0

        def flush() -> None:
            d, at = self.savings(blobs)
            n = np.diff(np.append(at, len(d)))
            over = [np.add.reduceat((d > t).astype(np.float64), at) for t in self.thresholds]
            typical = np.log(np.add.reduceat(np.exp(0.5 * np.clip(d, -40, 40)), at) / n)
            rows.append(np.stack([np.maximum.reduceat(d, at), typical, np.add.reduceat(d, at) / n, *(np.log1p(o) for o in over), *(o / n for o in over)], 1))
            blobs.clear()

        for t in texts:
            blobs.append(t.encode("utf-8", "replace"))
            size += len(blobs[-1])
            if size >= _BLOCK:
                flush()
                size = 0
        if blobs:
            flush()
        return np.concatenate(rows) if rows else np.zeros((0, 3 + 2 * len(self.thresholds)))

    def score(self, texts: list[str]) -> np.ndarray:
        if len(self.weights) == 1:
            return np.full(len(texts), 1 / (1 + np.exp(-self.weights[0])))
        z = self.weights[0] + ((self.features(texts) - self.mean) / self.scale) @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.001) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    z = np.c_[np.ones(len(x)), x]
    beta = np.zeros(z.shape[1])
    penalty = ridge * np.r_[0, np.ones(x.shape[1])]
    w = w / w.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (w * (p - y)) + penalty * beta
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), grad)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(toxic: list[str], ordinary: list[str], *, ordinary_weight: float = 1.0, bounds: Bounds = Bounds()) -> Model:  # noqa: B008
    """Train dictionaries on two thirds of the texts of each kind, calibrate on the rest.

    ``ordinary_weight`` is how many ordinary rows each sampled one stands for,
    relative to toxic ones. With no texts of one kind the score is constant: the
    share of toxic rows.
    """
    toxic, ordinary = list(dict.fromkeys(toxic)), list(dict.fromkeys(ordinary))
    if not toxic or not ordinary:
        share = float(np.clip(len(toxic) / max(len(toxic) + len(ordinary), 1), 0.01, 0.99))
        return Model(weights=np.array([np.log(share / (1 - share))]))
    parts = [([t for i, t in enumerate(x) if i % 3 or len(x) < 6], x[::3]) for x in (toxic, ordinary)]
    (tox, tox_held), (plain, plain_held) = parts
    tox_b, plain_b = ([t.encode("utf-8", "replace") for t in x] for x in (tox, plain))
    seen = []
    for blobs in (tox_b, plain_b):
        n = np.zeros(1 << BITS)
        for b in blobs:
            n[np.unique(_grams(b))] += 1
        seen.append(n)
    share_t, share_p = seen[0] / len(tox_b), seen[1] / len(plain_b)
    pooled = (seen[0] + seen[1] + 1) / (len(tox_b) + len(plain_b) + 2)
    z = (share_t - share_p) / np.sqrt(pooled * (1 - pooled) * (1 / len(tox_b) + 1 / len(plain_b)))
    often = share_t > 2.5 * (share_p + 1 / len(plain_b))
    telling = (z > 5) & often
    if telling.sum() < 20:  # few rows: the best there are
        telling = (z > 2.5) & often
    rng = np.random.default_rng(0)
    samples = [s for b in tox_b for s in _stretches(b, telling)]
    rng.shuffle(samples)
    windows = _drawn_windows(plain_b, bounds.ordinary_windows, rng)
    model = Model(ordinary=_train(bounds.ordinary_bytes, windows) or b" " * 8, toxic=_train(bounds.toxic_bytes, samples) if samples else b"")
    usual = np.concatenate([model.savings([t.encode("utf-8", "replace")])[0] for t in plain_held])
    model.thresholds = tuple(sorted({max(float(np.quantile(usual, 1 - p)), 0.0) for p in PASSING}))
    x = np.concatenate([model.features(tox_held), model.features(plain_held)])
    y = np.r_[np.ones(len(tox_held)), np.zeros(len(plain_held))]
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-6
    model.weights = _logistic((x - model.mean) / model.scale, y, np.where(y == 1, 1.0, ordinary_weight))
    return model


def train(docs: DataFrame, labels: DataFrame, *, bounds: Bounds = Bounds(), id_col: str = "doc_id", text_col: str = "text") -> Model:  # noqa: B008
    """Fit on a sample of labelled rows, drawn by a hash of the id; held-out rows take no part.

    Held out is an id whose text has a CRC-32 divisible by five. Ids labelled
    twice count as toxic if one label says so; null labels and ids are left out.
    Of rows with one id each different text takes part once; equal texts of any
    ids count once. Without labelled rows the score is constant.
    """
    known = (
        labels.select(F.col(id_col).alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
        .where("_toxic is not null and _id is not null")
        .groupBy("_id")
        .agg(F.max("_toxic").alias("_toxic"))
        .where(~held_out("_id"))
    )
    totals = {r["_toxic"]: r["n"] for r in known.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.col("_id").cast("string"))
    drawn = [known.where(F.col("_toxic") == k).orderBy(order, "_id").limit(n) for k, n in ((1, bounds.toxic_rows), (0, bounds.ordinary_rows))]
    picked = drawn[0].unionByName(drawn[1])  # at most toxic_rows + ordinary_rows ids
    texts = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    rows = texts.join(F.broadcast(picked), "_id").select("_id", "_toxic", "_text").dropDuplicates(["_id", "_text"]).repartition(1).sortWithinPartitions(order, "_id", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[str]] = {1: [], 0: []}
        most, left = {1: bounds.toxic_rows, 0: bounds.ordinary_rows}, bounds.sample_bytes
        for b in sliced(batches, 64):
            for k, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if len(found[k]) < most[k] and len(text) <= left:
                    found[k].append(text)
                    left -= len(text)
        per = [totals.get(k, 0) / max(len(found[k]), 1) for k in (1, 0)]
        model = fit(found[1], found[0], ordinary_weight=per[1] / per[0] if all(per) else 1.0, bounds=bounds)
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})

    made = rows.select("_id", "_toxic", "_text").mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else fit([], [], bounds=bounds)


def held_out(id_col: str) -> F.Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def score_toxicity(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every whole text, one row per input row.

    Null and empty texts get the score of a text without savings. Null ids stay
    null and are held out or not as the empty id is; repeated rows are scored
    each; other columns are not read.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), text_or_empty(text_col).alias("_text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            score = shared.value.score(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return src.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under 0.5, with all their columns, whatever their names.

    A null text scores as an empty one; repeated rows are each judged alike.
    """
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            score = shared.value.score([t or "" for t in b.column(at).to_pylist()])
            yield b.filter(pa.array(score < 0.5))

    return docs.mapInArrow(run, docs.schema)
