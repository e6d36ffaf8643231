"""Centroid clustering by k-means with bounds on distances (Hamerly).

Vectors are turned into integers, so that distances, sums and centroids are
exact and do not depend on the order of rows. Each vector keeps, besides its
cluster, one upper bound of the distance to its own centroid and one lower
bound of the distance to the second nearest. When centroids move, the upper
bound grows by its centroid's drift and the lower one shrinks by the largest
drift of the others. Only a vector whose bounds overlap is looked at again: its
upper bound is made exact, and if that does not settle it, it is compared with
all centroids in whole numbers. Bounds are rounded outwards, so that a vector
that is passed over cannot have changed, ties included.

Every round reads the vectors with their bounds and writes them anew. What
passes the driver are the centroids and their sums: ``k`` times the dimension.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import discard, materialize

#: Up to this size of a component all sums of products are whole numbers that doubles hold exactly (for up to 512 components).
_EXACT = 1 << 20
_LIMB = 30
_STATE = "vec_id bigint, x array<double>, cluster int, upper double, lower double, distance decimal(38,0), scans int"


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, -np.inf)


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)``, as doubles where these are exact, else as Python's integers."""
    if not x.size or np.abs(x).max() * scale < _EXACT:
        return np.floor(x * scale)
    return np.array([[_floor(v, scale) for v in row] for row in x.tolist()], object).reshape(x.shape)


def _floor(v: float, scale: int) -> int:
    n, d = v.as_integer_ratio()
    return n * scale // d


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all rows of ``c``, exact."""
    if x.dtype == object or c.dtype == object:
        x, c = (np.array([[int(v) for v in r] for r in m.tolist()], object).reshape(m.shape) for m in (x, c))
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]


def _root(d: np.ndarray) -> np.ndarray:
    """Square roots of whole numbers, at most some rounding errors off."""
    return np.sqrt(d.astype(np.float64)) if d.dtype != object else np.array([math.sqrt(v) if v < 1 << 1000 else math.inf for v in d.ravel().tolist()]).reshape(d.shape)


class Centroids:
    """Whole-number centroids, with what a round's bounds need of their last move."""

    def __init__(self, rows: list[list[int]], before: list[list[int]] | None = None) -> None:
        small = all(abs(v) < _EXACT for r in rows for v in r)
        self.rows, self.at = rows, np.array(rows, np.float64 if small else object)
        between = squared(self.at, self.at)
        k = len(rows)
        near = [min((between[i, j] for j in range(k) if j != i), default=None) for i in range(k)]
        # Half the way to the nearest other centroid: whoever is nearer than that belongs here.
        self.half = np.array([math.inf if v is None else math.sqrt(min(v, 1 << 1000)) / 2 * (1 - 1e-12) for v in near])
        self.drift = np.zeros(k)
        if before is not None:
            self.drift = np.array([math.sqrt(min(sum((a - b) ** 2 for a, b in zip(p, q, strict=True)), 1 << 1000)) * (1 + 1e-12) for p, q in zip(before, rows, strict=True)])
        most = np.argsort(-self.drift, kind="stable")[:2]
        self.others = np.array([self.drift[most[1]] if k > 1 and i == most[0] else self.drift[most[0]] for i in range(k)])

    def digest(self, i: int) -> str:
        return hashlib.sha256(",".join(map(str, self.rows[i])).encode()).hexdigest()


def assign(x: np.ndarray, c: Centroids, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, scans: np.ndarray, last: bool) -> tuple[np.ndarray, ...]:
    """One round for a batch of vectors; a negative cluster has no bounds yet. Exact distances come with ``last``."""
    new = cluster < 0
    own = np.where(new, 0, cluster)
    upper = np.where(new, np.inf, _up(upper + c.drift[own]))
    lower = np.where(new, -np.inf, _down(lower - c.others[own]))
    settled = np.maximum(lower, c.half[own])
    distance = np.zeros(len(x), x.dtype)
    doubtful = np.flatnonzero(~(upper < settled))
    tight = np.arange(len(x)) if last else doubtful
    for i in range(len(c.rows)):
        at = tight[own[tight] == i]
        if len(at):
            d = squared(x[at], c.at[i : i + 1])[:, 0]
            if d.dtype == object and distance.dtype != object:
                distance = distance.astype(object)
            distance[at] = d
            upper[at] = _root(d) * (1 + 1e-12)
    scan = doubtful[new[doubtful] | ~(upper[doubtful] < settled[doubtful])]
    if len(scan):
        d = squared(x[scan], c.at)
        best = d.argmin(1) if d.dtype != object else np.array([min(range(d.shape[1]), key=lambda j, r=r: (r[j], j)) for r in d.tolist()])
        cluster = own.copy()
        cluster[scan] = best
        nearest = d[np.arange(len(scan)), best]
        if nearest.dtype == object and distance.dtype != object:
            distance = distance.astype(object)
        distance[scan] = nearest
        upper[scan] = _root(nearest) * (1 + 1e-12)
        if d.shape[1] > 1:
            rest = d.copy()
            rest[np.arange(len(scan)), best] = d.max() + 1
            lower[scan] = _root(rest.min(1)) * (1 - 1e-12)
        else:
            lower[scan] = np.inf
        scans = scans.copy()
        scans[scan] += 1
    return cluster, upper, lower, distance, scans


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1)


def _round(state: DataFrame, c: Centroids, scale: int, last: bool) -> DataFrame:
    shared = state.sparkSession.sparkContext.broadcast(c)  # k vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            value = lambda i: b.column(i).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            x = whole_numbers(_matrix(b.column(1)), scale)
            cluster, upper, lower, distance, scans = assign(x, shared.value, value(2), value(3), value(4), value(6), last)
            fits = pa.array([int(d) if d < 10**38 else None for d in distance.tolist()], pa.decimal128(38, 0)) if last else pa.nulls(len(x), pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower), fits, pa.array(scans, pa.int32())], names=["vec_id", "x", "cluster", "upper", "lower", "distance", "scans"])

    return materialize(state.mapInArrow(run, _STATE), "clusters")


def _sums(state: DataFrame, dim: int, scale: int) -> dict[int, tuple[int, list[int]]]:
    """Number and exact sum of each cluster's vectors; tasks pass on a few numbers a cluster and component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, int] = {}
        total: dict[int, list[int]] = {}
        for b in batches:
            x, at = whole_numbers(_matrix(b.column(1)), scale), b.column(0).to_numpy(zero_copy_only=False)
            for i in np.unique(at).tolist():
                own = x[at == i]
                n[i] = n.get(i, 0) + len(own)
                total[i] = [a + int(v) for a, v in zip(total.get(i, [0] * dim), own.sum(0).tolist(), strict=True)]
        out = []
        for i, row in total.items():
            out.append((i, -1, 0, n[i]))
            for j, v in enumerate(row):
                for limb, part in enumerate(_limbs(v)):
                    out.append((i, j, limb, part))
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["cluster", "j", "limb", "v"])

    parts = state.select("cluster", "x").mapInArrow(run, "cluster int, j int, limb int, v bigint")
    found: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("cluster", "j", "limb").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("v")).collect():
        n, row = found.get(r["cluster"], (0, [0] * dim))
        if r["j"] < 0:
            n = int(r["v"])
        else:
            row[r["j"]] += int(r["v"]) << _LIMB * r["limb"]
        found[r["cluster"]] = (n, row)
    return found


def _limbs(v: int) -> Iterator[int]:
    """``v`` in digits of so many bits, each with the sign of ``v``, so that sums of sums fit in a long."""
    sign, v = (-1 if v < 0 else 1), abs(v)
    while True:
        yield sign * (v & ((1 << _LIMB) - 1))
        v >>= _LIMB
        if not v:
            return


def cluster_vectors(vectors: DataFrame, *, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, scans`` of every usable vector, written.

    Usable are vectors with exactly ``dim`` components, none null or not finite;
    others have no row, nor does an empty table. Components become
    ``floor(scale * x)``. Centroids start as the ``k`` vectors with the smallest
    SHA-256 of ``seed:id`` (fewer, if there are fewer; a null id counts as
    empty; equal ids by their vectors); an empty cluster keeps its centroid.
    Equal distances go to the smaller number; repeated rows have a row each.
    ``scans`` is how often the vector was compared with all centroids, of
    ``rounds + 1`` times. A distance or sum too large for a long is null. Other
    columns are not read.
    """
    spark = vectors.sparkSession
    x = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf)))
    usable = named.where((F.size("x") == dim) & F.coalesce(finite, F.lit(False)))
    hashed = usable.withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256))
    start = [[_floor(v, scale) for v in r["x"]] for r in hashed.orderBy("_h", "x").limit(k).collect()]
    none = F.lit(0.0)
    state = usable.select("vec_id", "x", F.lit(-1).alias("cluster"), none.alias("upper"), none.alias("lower"), F.lit(None).cast("decimal(38,0)").alias("distance"), F.lit(0).alias("scans"))
    if not start:
        return state.select("vec_id", "cluster", *(F.col("distance").cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"), "scans")
    centroids = Centroids(start)
    for i in range(rounds + 1):
        nearer = _round(state, centroids, scale, i == rounds)
        if i:
            discard(state)
        state = nearer
        if i < rounds:
            sums = _sums(state, dim, scale)
            moved = [[v // sums[j][0] for v in sums[j][1]] if j in sums else row for j, row in enumerate(centroids.rows)]
            centroids = Centroids(moved, centroids.rows)
    # A row for each centroid.
    per = state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()
    whole = None if any(r["s"] is None for r in per) else sum(int(r["s"]) for r in per)
    fits = lambda v: int(v) if v is not None and v < 1 << 63 else None
    table = spark.createDataFrame([(r["cluster"], fits(r["s"]), fits(whole), centroids.digest(r["cluster"])) for r in per], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return state.join(F.broadcast(table), "cluster").select("vec_id", "cluster", F.expr("try_cast(distance as bigint)").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256", "scans")
