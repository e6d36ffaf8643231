"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample and broadcast; its size is that of the
sample's. Every vector is put into the leaf it descends to. A query walks the
tree best bin first: a priority queue holds nodes by the distance of their
centre, and leaves are visited in the order in which they leave it. How many
leaves are visited is calibrated: a bounded set of probe vectors is compared
with all vectors by brute force, and visits are widened until the wanted share
of the true neighbours lies in visited leaves.

Vectors and visiting queries then meet by leaf, in two rounds: the first few
leaves give each query k+1 distances, and from all other leaves only vectors
that are no farther than the last of these are passed on. Leaves (and their visitors)
beyond a set number are split into parts, so no task holds a whole hot leaf.
Of equal vectors only the k+1 smallest ids can be anybody's neighbours; the
others are left out of the candidates beforehand, which loses nothing, and
queries with equal vectors are searched once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.llm.common import materialize, parallelism


@dataclass(frozen=True)
class Settings:
    sample: int = 16_384  # vectors the tree is fitted on
    branching: int = 8
    leaf: int = 24  # sample vectors in a leaf
    probes: int = 200  # vectors that the number of visits is calibrated on
    recall: float = 0.97  # what calibration asks for
    ahead: int = 8  # leaves of the first round
    part: int = 4096  # vectors, or visiting queries, of a leaf that meet in one group


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    d = (centres**2).sum(1)[None, :] - 2 * (x @ centres.T)
    return d.argmin(1)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, centres)
        for j in range(k):
            if (own := at == j).any():
                centres[j] = x[own].mean(0)
    return centres


@dataclass
class Tree:
    """Nodes by number; node 0 is the root. A leaf has no children and has a leaf number."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[np.ndarray] = field(default_factory=list)  # centres of a node's children, row by row
    first: list[int] = field(default_factory=list)  # number of a node's first child; children are consecutive
    leaf_no: list[int] = field(default_factory=list)
    n_leaves: int = 0

    @classmethod
    def fit(cls, x: np.ndarray, settings: Settings) -> Tree:
        rng = np.random.default_rng(0)
        tree = cls()
        x = np.asarray(x, np.float64)
        tree._add(x.mean(0) if len(x) else np.zeros(1))
        todo = [(0, x)]
        while todo:
            node, own = todo.pop()
            groups = []
            if len(own) > settings.leaf:
                centres = _kmeans(own, min(settings.branching, len(own)), rng)
                at = _nearest(own, centres)
                groups = [own[at == j] for j in range(len(centres)) if (at == j).any()]
            if len(groups) < 2:
                tree.leaf_no[node] = tree.n_leaves
                tree.n_leaves += 1
                continue
            tree.first[node] = len(tree.centres)
            middles = np.stack([g.mean(0) for g in groups])
            tree.children[node] = middles
            for g, m in zip(groups, middles, strict=True):
                todo.append((tree._add(m), g))
        return tree

    def _add(self, centre: np.ndarray) -> int:
        self.centres.append(centre)
        self.children.append(np.zeros((0, len(centre))))
        self.first.append(-1)
        self.leaf_no.append(-1)
        return len(self.centres) - 1

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf_no[node] >= 0:
                out[rows] = self.leaf_no[node]
            elif len(rows):
                at = _nearest(x[rows], self.children[node])
                todo += [(self.first[node] + j, rows[at == j]) for j in range(len(self.children[node])) if (at == j).any()]
        return out

    def visits(self, query: np.ndarray) -> Iterator[int]:
        """Leaf numbers, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.leaf_no[node] >= 0:
                yield self.leaf_no[node]
                continue
            d = ((self.children[node] - query) ** 2).sum(1)
            for j, dist in enumerate(d.tolist()):
                heapq.heappush(queue, (dist, self.first[node] + j))


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, from differences (no cancellation)."""
    out = np.empty((len(q), len(x)))
    step = max(1, (1 << 22) // max(x.size, 1))
    for i in range(0, len(q), step):
        out[i : i + step] = np.sqrt(((q[i : i + step, None, :] - x[None, :, :]) ** 2).sum(2))
    return out


def top(dist: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest by (distance, id)."""
    if len(dist) > 4 * k:
        keep = np.flatnonzero(dist <= np.partition(dist, k - 1)[k - 1])
    else:
        keep = np.arange(len(dist))
    return keep[np.lexsort((ids[keep], dist[keep]))[:k]]


def usable(vector: Column, dim: int) -> Column:
    x = vector
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return x.isNotNull() & (F.size(x) == dim) & F.coalesce(finite, F.lit(False)) & F.exists(x, lambda v: v != 0)


_META = "id bigint, v array<double>"


def nearest_neighbours(
    vectors: DataFrame,
    queries: Column,
    *,
    k: int = 10,
    settings: Settings = Settings(),  # noqa: B008
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each row that ``queries`` holds for.

    Candidates are all rows but the query's own; score is the Euclidean distance,
    ties go to the smaller id. Vectors that are null, zero, or hold null or
    non-finite components take no part, nor do rows without an id or with another
    number of components than most have. A row that is repeated counts once.
    With fewer than k candidates, all are returned. An empty table gives none.
    """
    spark = vectors.sparkSession
    base = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("_raw"), queries.alias("is_query"))
    common = base.where(F.size("_raw") > 0).groupBy(F.size("_raw").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if common is None:
        return spark.createDataFrame([], schema)
    dim = common["d"]
    rows = materialize(
        base.where(usable(F.col("_raw"), dim)).select("id", F.col("_raw").cast("array<double>").alias("v"), "is_query").groupBy("id", "v").agg(F.max("is_query").alias("is_query")),
        "ann-rows",
    )
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    candidates = materialize(rows.select("id", "v", rank.alias("rn")).where(F.col("rn") <= k + 1).drop("rn"), "ann-candidates")

    drawn = [np.array(r["v"]) for r in candidates.orderBy(F.xxhash64("id"), "id").limit(settings.sample).select("v").collect()]
    if not drawn:
        return spark.createDataFrame([], schema)
    tree = Tree.fit(np.stack(drawn), settings)
    shared = spark.sparkContext.broadcast(tree)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.leaf_of(_matrix(b.column(1))), pa.int64())], names=["id", "v", "leaf"])

    index = materialize(candidates.mapInArrow(assign, f"{_META}, leaf bigint"), "ann-index")
    held = {r["leaf"]: r["count"] for r in index.groupBy("leaf").count().collect()}  # at most one row a leaf
    visits = _calibrate(index, tree, k, settings)

    asked = rows.where("is_query").groupBy("v").agg(F.min("id").alias("id")).select("id", "v")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, leaves, order = [], [], []
            for i, q in enumerate(_matrix(b.column(1))):
                found = n = 0
                for leaf in shared.value.visits(q):
                    if leaf in held:
                        take.append(i)
                        leaves.append(leaf)
                        order.append(0 if found <= 2 * k + 1 or n < settings.ahead else 1)
                        found += held[leaf]
                    n += 1
                    if n >= visits and found > 2 * k + 1:
                        break
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(leaves, pa.int64()), pa.array(order, pa.int32())], names=["id", "v", "leaf", "round"])

    spread = asked.repartition(parallelism(spark), "id")  # a walk costs far more than its row's bytes tell
    routed = materialize(spread.mapInArrow(route, f"{_META}, leaf bigint, round int"), "ann-routed")
    visitors = {r["leaf"]: r["count"] for r in routed.groupBy("leaf").count().collect()}
    sizes = spark.createDataFrame(
        [(leaf, -(-n // settings.part), max(1, -(-visitors.get(leaf, 0) // settings.part))) for leaf, n in held.items()], "leaf bigint, vparts int, qparts int"
    )

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        part = F.pmod(F.xxhash64("id"), F.col(f"{own}s")).cast("int").alias(own)
        rest = [c for c in df.columns if c not in ("id", "v", "leaf")]
        return df.join(F.broadcast(sizes), "leaf").select("id", "v", "leaf", *rest, part, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)).alias(other))

    keys = ["leaf", "vpart", "qpart"]
    def meet(xs: pa.Table, qs: pa.Table) -> pa.Table:
        query, vec, score = [], [], []
        if xs.num_rows and qs.num_rows:
            ids, x = xs["id"].to_numpy(), _matrix(xs["v"].combine_chunks())
            for qid, q, bound in zip(qs["id"].to_pylist(), _matrix(qs["v"].combine_chunks()), qs["bound"].to_pylist(), strict=True):
                d = distances(q[None], x)[0]
                best = top(d, ids, k + 1)
                best = best[d[best] <= bound]
                query += [qid] * len(best)
                vec += ids[best].tolist()
                score += d[best].tolist()
        return pa.table({"rep": pa.array(query, pa.int64()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(score, pa.float64())})

    def searched(visitors: DataFrame) -> DataFrame:
        left, right = dealt(index, "vpart", "qpart"), dealt(visitors, "qpart", "vpart")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "rep bigint, vec_id bigint, score double")

    def nearest(df: DataFrame) -> DataFrame:
        return df.withColumn("rn", F.row_number().over(Window.partitionBy("rep").orderBy("score", "vec_id"))).where(F.col("rn") <= k + 1)

    ahead = materialize(nearest(searched(routed.where("round = 0").drop("round").withColumn("bound", F.lit(float("inf"))))), "ann-ahead")
    bounds = ahead.where(F.col("rn") == k + 1).select(F.col("rep").alias("id"), F.col("score").alias("bound"))
    wider = routed.where("round = 1").drop("round").join(bounds, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    best = nearest(ahead.drop("rn").unionByName(searched(wider))).drop("rn")
    same = rows.where("is_query").select(F.col("id").alias("query_id"), "v").join(asked.select(F.col("id").alias("rep"), "v"), "v").drop("v")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        same.join(best, "rep")
        .where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def _calibrate(index: DataFrame, tree: Tree, k: int, settings: Settings) -> int:
    """The least number of leaves whose visit finds ``settings.recall`` of the probes' true neighbours."""
    probes = index.orderBy(F.xxhash64(F.lit("probe"), "id"), "id").limit(settings.probes).collect()
    ids = np.array([r["id"] for r in probes])
    points = np.array([r["v"] for r in probes])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, int, int]]] = [[] for _ in ids]
        for b in batches:
            own, x, leaf = b.column(0).to_numpy(), _matrix(b.column(1)), b.column(2).to_numpy()
            for s in range(0, len(own), 4096):
                d = distances(points, x[s : s + 4096]) if len(own) else np.zeros((len(ids), 0))
                for i in range(len(ids)):
                    d[i][own[s : s + 4096] == ids[i]] = np.inf
                    at = top(d[i], own[s : s + 4096], k)
                    best[i] = sorted(best[i] + [(float(d[i][j]), int(own[s + j]), int(leaf[s + j])) for j in at if np.isfinite(d[i][j])])[:k]
        rows = [(i, *x) for i, row in enumerate(best) for x in row]
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["probe", "d", "id", "leaf"])

    order = Window.partitionBy("probe").orderBy("d", "id")
    true = index.mapInArrow(nearest, "probe int, d double, id bigint, leaf bigint").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k).select("probe", "leaf").collect()
    if not true:
        return tree.n_leaves
    wanted: dict[int, list[int]] = {}
    for r in true:
        wanted.setdefault(r["probe"], []).append(r["leaf"])
    places = []
    for i, leaves in wanted.items():
        missing = set(leaves)
        for n, leaf in enumerate(tree.visits(points[i]), 1):
            if leaf in missing:
                places += [n] * leaves.count(leaf)
                missing.discard(leaf)
                if not missing:
                    break
    places.sort()
    return places[min(len(places) - 1, int(np.ceil(settings.recall * len(places))) - 1)]


def brute_force(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, k: int = 10) -> dict[int, list[tuple[int, float]]]:
    """Exact neighbours on the driver, for tests."""
    out = {}
    where = {int(i): j for j, i in enumerate(ids)}
    for q in query_ids.tolist():
        d = distances(x[where[q]][None], x)[0]
        d[where[q]] = np.inf
        best = [j for j in top(d, ids, k) if np.isfinite(d[j])]
        out[q] = [(int(ids[j]), float(d[j])) for j in best]
    return out
