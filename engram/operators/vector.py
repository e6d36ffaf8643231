"""Exact cosine search, one query or a table of queries.

A task multiplies its rows with query vectors and passes on its best rows only,
so the product of queries and rows never leaves a task. A bounded number of
queries is sent to every task; more of them meet the rows in blocks. Where rows
carry a quantised vector, its error bound tells which of them can be among the
best, and only these have their vectors read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from engram.functions.vectors import cosine, micro_key, norm, well_formed
from engram.operators.lexical import ranked
from engram.schemas import BRANCH_LIMIT, MICRO_COSINE_FLOOR

#: Query vectors that are sent to every task; more meet the rows in blocks.
MAX_SENT = 4096
#: About so many queries and rows meet in one group.
QUERY_BLOCK, ROW_BLOCK = 16_384, 65_536
#: Products are made of so many queries at a time.
_COLUMNS = 256
#: Row ids up to this number are pushed down to the files; beyond, they are joined.
MAX_PUSHED_IDS = 1_000
LEVELS = 127


def cosine_keys(memories: DataFrame, vector: list[float]) -> DataFrame:
    """``memory_id, cosine, key`` of rows with a usable vector (native)."""
    q = F.array(*(F.lit(float(x)) for x in vector))
    ok = memories.where(well_formed(F.col("embedding"), len(vector)))
    cos = cosine(F.col("embedding"), q)
    return ok.select("memory_id", "brain_id", cos.alias("cosine"), micro_key(cos).alias("key"))


def quantised(memories: DataFrame) -> DataFrame:
    """``memories`` with ``code`` (a signed byte for each component), ``step`` and ``error``; null for an unusable vector (native).

    The unit vector is ``step * code`` with a difference of length ``error`` at
    most, so that no cosine is off by more.
    """
    v = F.col("embedding")
    usable = F.when(well_formed(v, F.size(v)), v)
    length, most = norm(F.col("_usable")), F.array_max(F.transform("_usable", lambda x: F.abs(x.cast("double"))))
    byte = F.transform("_usable", lambda x: F.rint(x.cast("double") / F.col("_most") * LEVELS).cast("int"))
    off = F.zip_with("_usable", "_codes", lambda x, c: x.cast("double") / F.col("_length") - c * F.col("step"))
    hexed = F.transform("_codes", lambda c: F.lpad(F.hex(c.bitwiseAND(F.lit(255))), 2, "0"))
    steps = memories.withColumn("_usable", usable).withColumns({"_length": length, "_most": most})
    coded = steps.withColumns({"_codes": byte, "step": F.col("_most") / F.col("_length") / LEVELS})
    error = F.sqrt(F.aggregate(off, F.lit(0.0), lambda s, x: s + x * x)) * (1 + 1e-9) + 1e-12
    return coded.withColumns({"code": F.unhex(F.array_join(hexed, "")), "error": error}).drop("_usable", "_length", "_most", "_codes")


def vector_branch(memories: DataFrame, queries: DataFrame, eligible: Column, *, limit: int = BRANCH_LIMIT, floor: int = MICRO_COSINE_FLOOR) -> DataFrame:
    """``query_id, memory_id, key, rank`` for ``queries`` of ``query_id, brain_id, vector``.

    The floor comes before the rank; ties on the rounded key go to the smaller
    id. Rows with malformed vectors are no candidates. If ``memories`` is what
    ``quantised`` gave, vectors are read of those rows only that can be among the
    best; the result is the same.
    """
    asked = queries.where("vector is not null").select("query_id", "brain_id", F.col("vector").cast("array<double>").alias("vector"))
    rows = memories.where(eligible)
    few = asked.limit(MAX_SENT + 1).collect()
    if len(few) > MAX_SENT:
        found = _in_blocks(rows, asked, limit, floor)
    else:
        sent = [(r["query_id"], r["brain_id"], r["vector"]) for r in few]
        if "code" in memories.columns and sent:
            rows = _reachable(rows, sent, limit, floor, queries.schema["query_id"].dataType)
        found = _sent(rows, sent, limit, floor, queries.schema["query_id"].dataType)
    return ranked(found, [F.col("key").desc(), F.col("memory_id").asc()], limit)


class _Best:
    """Of each query the ``limit`` rows of largest key so far; of equal keys the smaller ids."""

    def __init__(self, limit: int, floor: int) -> None:
        self.limit, self.floor = limit, floor
        self.rows: dict[object, list[tuple[int, str]]] = {}

    def add(self, qids: list, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """``q`` has a unit vector in each column, ``x`` one in each row."""
        for i in range(0, len(qids), _COLUMNS):
            keys = np.rint((x @ q[:, i : i + _COLUMNS]) * 1e6)
            for j, qid in enumerate(qids[i : i + _COLUMNS]):
                k = keys[:, j]
                own = np.flatnonzero(k >= self.floor)
                if len(own) > self.limit:
                    # All that tie with the last one stay until ids are compared.
                    own = own[k[own] >= np.partition(k[own], -self.limit)[-self.limit]]
                if len(own):
                    have = self.rows.get(qid, []) + [(-int(k[n]), ids[n]) for n in own]
                    self.rows[qid] = sorted(have)[: self.limit]

    def batch(self, kind: pa.DataType) -> pa.RecordBatch:
        out = [(q, m, -k) for q, rows in self.rows.items() for k, m in rows]
        cols = list(zip(*out, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (kind, pa.string(), pa.int64()), strict=True)], names=["query_id", "memory_id", "key"])


def _units(v: pa.Array, dim: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the usable ones among rows ``at``, which have ``dim`` components, and their rows."""
    flat, ends = v.values.to_numpy(zero_copy_only=False).astype(np.float64), v.offsets.to_numpy()
    x = flat[ends[at][:, None] + np.arange(dim)]
    with np.errstate(invalid="ignore", over="ignore"):
        length = np.linalg.norm(x, axis=1)
    fine = np.isfinite(length) & (length > 0)
    return x[fine] / length[fine][:, None], at[fine]


def _sizes(v: pa.Array) -> np.ndarray:
    return np.nan_to_num(np.array(v.value_lengths().to_numpy(zero_copy_only=False), np.float64), nan=-1)


def _matrices(asked: list[tuple]) -> dict[tuple[str, int], tuple[list, np.ndarray]]:
    """Query ids and unit vectors, in columns, by brain and number of components."""
    groups: dict[tuple[str, int], list[tuple]] = {}
    for q, brain, v in asked:
        groups.setdefault((brain, len(v)), []).append((q, v))
    out = {}
    for key, own in groups.items():
        m = np.array([v for _, v in own], np.float64)
        with np.errstate(invalid="ignore", divide="ignore"):
            out[key] = ([q for q, _ in own], (m / np.linalg.norm(m, axis=1)[:, None]).T)
    return out


def _objects(col: pa.Array) -> np.ndarray:
    return np.array(col.to_pylist(), object)


def _sent(rows: DataFrame, asked: list[tuple], limit: int, floor: int, kind: T.DataType) -> DataFrame:
    """Each task's best rows of each query."""
    shared, arrow = rows.sparkSession.sparkContext.broadcast(_matrices(asked)), to_arrow_type(kind)  # MAX_SENT vectors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(limit, floor)
        for b in batches:
            brains, ids, v = _objects(b.column(0)), _objects(b.column(1)), b.column(2)
            sizes = _sizes(v)
            for (brain, dim), (qids, q) in shared.value.items():
                at = np.flatnonzero((brains == brain) & (sizes == dim))
                if len(at):
                    x, at = _units(v, dim, at)
                    best.add(qids, q, ids[at], x)
        yield best.batch(arrow)

    return rows.select("brain_id", "memory_id", "embedding").mapInArrow(run, f"query_id {kind.simpleString()}, memory_id string, key bigint")


def _in_blocks(rows: DataFrame, asked: DataFrame, limit: int, floor: int) -> DataFrame:
    """The best rows of each query and block of rows.

    Queries and rows are dealt into blocks by hash; every block of queries meets
    every block of rows of its brain in a group of its own, of bounded size. A row
    is sent once for each block of queries and a query once for each block of
    rows; the driver sees two counts.
    """
    n_q, n_r = (-(-df.count() // size) or 1 for df, size in ((asked, QUERY_BLOCK), (rows, ROW_BLOCK)))
    kind = asked.schema["query_id"].dataType
    arrow = to_arrow_type(kind)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = asked.select("brain_id", block("query_id", n_q).alias("_q"), every(n_r).alias("_r"), "query_id", "vector")
    right = rows.where(F.col("embedding").isNotNull()).select("brain_id", every(n_q).alias("_q"), block("memory_id", n_r).alias("_r"), "memory_id", "embedding")
    key = ["brain_id", "_q", "_r"]

    def run(queries: pa.Table, own: pa.Table) -> pa.Table:
        best = _Best(limit, floor)
        if queries.num_rows and own.num_rows:
            vectors = zip(queries["query_id"].to_pylist(), queries["vector"].to_pylist(), strict=True)
            asked_here = _matrices([(q, "", v) for q, v in vectors])
            for b in own.to_batches(max_chunksize=4096):
                ids, v = _objects(b.column("memory_id")), b.column("embedding")
                sizes = _sizes(v)
                for (_, dim), (qids, q) in asked_here.items():
                    at = np.flatnonzero(sizes == dim)
                    if len(at):
                        x, at = _units(v, dim, at)
                        best.add(qids, q, ids[at], x)
        return pa.Table.from_batches([best.batch(arrow)])

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, f"query_id {kind.simpleString()}, memory_id string, key bigint")


def _reachable(rows: DataFrame, asked: list[tuple], limit: int, floor: int, kind: T.DataType) -> DataFrame:
    """The rows of ``rows`` whose quantised vector allows them to be among some query's best.

    A row's cosine lies between two bounds. The lower ones of enough rows give a
    least cosine of the last rank; rows whose upper bound is below are no
    candidates. Keys are rounded to millionths, so rows that near to the least
    one stay.
    """
    shared, arrow = rows.sparkSession.sparkContext.broadcast(_matrices(asked)), to_arrow_type(kind)
    least, near = (floor - 1) / 1e6, 2e-6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[object, np.ndarray] = {}  # a query's largest lower bounds in this task
        for b in batches:
            brains, ids, code = _objects(b.column(0)), _objects(b.column(1)), b.column(2)
            sizes = np.array([-1 if c is None else len(c) for c in code.to_pylist()])
            step, error = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
            found: list[tuple] = []
            for (brain, dim), (qids, q) in shared.value.items():
                at = np.flatnonzero((brains == brain) & (sizes == dim))
                if not len(at):
                    continue
                x = np.frombuffer(b"".join(code.take(pa.array(at)).to_pylist()), np.int8).reshape(len(at), dim).astype(np.float32)
                s, e = step[at], error[at] + 1e-6 * np.sqrt(dim)  # products are made in single precision
                for i in range(0, len(qids), _COLUMNS):
                    about = (x @ q[:, i : i + _COLUMNS].astype(np.float32)) * s[:, None]
                    for j, qid in enumerate(qids[i : i + _COLUMNS]):
                        low, high = about[:, j] - e, about[:, j] + e
                        bounds = np.sort(np.concatenate([last.get(qid, np.zeros(0)), low]))[-limit:]
                        last[qid] = bounds
                        bar = max(least, bounds[0] - near) if len(bounds) == limit else least
                        found += [(qid, brain, ids[at[n]], float(low[n]), float(high[n])) for n in np.flatnonzero(high >= bar)]
            cols = list(zip(*found, strict=True)) or [[]] * 5
            kinds = (arrow, pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["query_id", "brain_id", "memory_id", "low", "high"])

    bounds = rows.select("brain_id", "memory_id", "code", "step", "error").mapInArrow(run, f"query_id {kind.simpleString()}, brain_id string, memory_id string, low double, high double")
    # Of a query each task has sent few more rows than are wanted; bytes are read once for both windows.
    own = Window.partitionBy("query_id")
    placed = bounds.withColumn("_n", F.row_number().over(own.orderBy(F.col("low").desc())))
    barred = placed.withColumn("_bar", F.max(F.when(F.col("_n") == limit, F.col("low"))).over(own))
    reach = barred.where(F.col("_bar").isNull() | (F.col("high") + near >= F.col("_bar")))
    keys = reach.select("brain_id", "memory_id").distinct()
    few = keys.limit(MAX_PUSHED_IDS + 1).collect()
    if len(few) > MAX_PUSHED_IDS:
        return rows.join(keys, ["brain_id", "memory_id"], "left_semi")
    # Single comparisons are checked against the pages' bounds; a set would be by its least and largest value only.
    wanted = [F.col("memory_id") == m for m in sorted({r["memory_id"] for r in few})]
    while len(wanted) > 1:
        wanted = [reduce(or_, wanted[i : i + 2]) for i in range(0, len(wanted), 2)]
    return rows.where(wanted[0]) if wanted else rows.limit(0)
