"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted. A shard's pieces are taken in order of
falling length; each goes to the open bin it leaves least room in. Where none
fits, the capacity is opened whose cost per token that it is going to hold is
least: a bin costs ``overhead + length + length**2 / quadratic`` and can be
filled at most by the piece and what is left of the shard's shorter pieces. At
the end every bin is downsized to the shortest permitted length that holds its
contents.

Best-fit is sequential, so pieces are dealt to shards by a hash of their row and
number; there are as many shards as hold ``block`` pieces each, whatever the
session's partitions. A shard is packed in one streaming pass over blocks of
``block`` pieces, so memory is bounded even where one gets more than its share.
Only ids and lengths are dealt; texts are joined to the result where asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.common import discard, fresh, materialize, running, text_or_empty

LENGTHS = (512, 1024, 2048, 4096)


def word_count(text_col: str = "text") -> Column:
    """Number of white-space separated words, counted as gaps; native."""
    text = F.trim(F.regexp_replace(text_or_empty(text_col), r"\s+", " "))
    return F.when(text == "", F.lit(0)).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("long")


class Costs:
    def __init__(self, lengths: tuple[int, ...] = LENGTHS, overhead: float = 32.0, quadratic: float = 32_768.0) -> None:
        if not lengths or min(lengths) < 1:
            raise ValueError("at least one permitted length is needed, all positive")
        self.lengths = tuple(sorted(set(lengths)))
        self.cost = {c: overhead + c + c * c / quadratic for c in self.lengths}

    def opening(self, size: int, rest: int) -> int:
        """The capacity to open for a piece of ``size`` when shorter pieces hold ``rest`` tokens."""
        fits = [c for c in self.lengths if c >= size]
        return min(fits, key=lambda c: (self.cost[c] / min(c, size + rest), c))

    def downsized(self, used: int) -> int:
        return next(c for c in self.lengths if c >= used)


def best_fit(sizes: np.ndarray, costs: Costs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each piece its bin and the offset in it; for each bin its final capacity."""
    order = np.lexsort((np.arange(len(sizes)), -sizes))
    rest = int(sizes.sum())
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    used: list[int] = []
    opened: list[int] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set where a bin with r tokens of room is open
    for i in order.tolist():
        size = int(sizes[i])
        rest -= size
        if above := rooms >> size:
            room = size + (above & -above).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            at = len(used)
            used.append(0)
            opened.append(costs.opening(size, rest))
        bins[i], offsets[i] = at, used[at]
        used[at] += size
        if room := opened[at] - used[at]:
            by_room.setdefault(room, []).append(at)
            rooms |= 1 << room
    return bins, offsets, np.array([costs.downsized(u) for u in used], np.int64)


RESULT = ("doc_id", "copy", "piece", "start", "n_tokens", "bin_id", "capacity", "bin_offset")


def pack_documents(
    docs: DataFrame,
    *,
    lengths: tuple[int, ...] = LENGTHS,
    size: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    block: int = 16_384,
    keep: tuple[str, ...] = (),
    with_text: bool = False,
) -> DataFrame:
    """``doc_id, copy, piece, start, n_tokens, bin_id, capacity, bin_offset`` and the columns in ``keep``.

    ``size`` is the length of a row in tokens, by default its words. A document
    longer than the longest permitted length is cut there, again and again; its
    pieces count from 0 and ``start`` is a piece's first token. Rows with equal
    id, text and columns in ``keep`` are copies, numbered from 1 and packed each
    for itself; rows of one id with different texts have numbers one after the
    other, by a hash of the text. So (``doc_id``, ``copy``, ``piece``) is a key.
    A row without tokens (null or empty text) has one piece of 0 tokens in no bin
    (null). Null ids stay null; an empty table gives an empty table. ``bin_id``
    holds the shard in its upper bits. ``with_text`` adds ``text``, the piece's
    own text with its white space; it takes words as tokens. A name in ``keep``
    that clashes with a result column is an error.
    """
    costs = Costs(lengths)
    top = costs.lengths[-1]
    if with_text and size is not None:
        raise ValueError("texts are cut by words; leave size out")
    if clash := {k.lower() for k in keep} & {*RESULT, "text"}:
        raise ValueError(f"columns named like results: {sorted(clash)}")
    total, th, times = (fresh(c, [*RESULT, *keep]) for c in ("_total", "_th", "_times"))
    text = text_or_empty(text_col)
    sized = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias(th), (word_count(text_col) if size is None else size).cast("long").alias(total), *keep)
    # Ids and lengths only; texts are read once for them.
    rows = materialize(sized.groupBy("doc_id", th, total, *keep).agg(F.count("*").alias(times)), "packing-rows")
    numbered = _numbered(rows, th, total, times, keep)
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col(total) / top) - 1, F.lit(0).cast("long"))))
    pieces = (
        numbered.select("doc_id", "copy", th, total, piece.alias("piece"), *keep)
        .withColumn("start", F.col("piece") * top)
        .withColumn("n_tokens", F.least(F.lit(top).cast("long"), F.col(total) - F.col("start")))
        .select("doc_id", "copy", "piece", "start", "n_tokens", *keep, th)
    )
    names = pieces.columns
    # Some room is left, so that no shard has more than a block by chance.
    n = -(-docs.count() * 4 // (3 * block)) or 1
    # Within a shard the order is that of another hash: a block is then a fair sample of all lengths.
    key = F.col("doc_id").cast("string")
    shards = pieces.repartition(n, F.xxhash64(key, th, "copy", "piece")).sortWithinPartitions(F.xxhash64("piece", key, th), "doc_id", "copy", "piece", "n_tokens")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    at_size = names.index("n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        next_bin = TaskContext.get().partitionId() << 40
        held: list[pa.RecordBatch] = []

        def packed() -> pa.RecordBatch:
            nonlocal next_bin
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            sizes = rows.column(at_size).to_numpy(zero_copy_only=False)
            real = sizes > 0
            bins, offsets, caps = best_fit(sizes[real], costs)
            wide = [np.zeros(len(sizes), np.int64) for _ in range(3)]
            for w, v in zip(wide, (bins + next_bin, caps[bins] if len(caps) else caps, offsets), strict=True):
                w[real] = v
            next_bin += len(caps)
            return pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(w, pa.int64(), mask=~real) for w in wide)], names=[*names, "bin_id", "capacity", "bin_offset"])

        for whole in batches:
            while whole.num_rows:
                b = whole.slice(0, block - sum(h.num_rows for h in held))
                held.append(b)
                whole = whole.slice(b.num_rows)
                if sum(h.num_rows for h in held) == block:
                    yield packed()
        if held:
            yield packed()

    out = shards.mapInArrow(run, f"{fields}, bin_id bigint, capacity bigint, bin_offset bigint")
    if not with_text:
        return out.select(*RESULT, *keep)
    doc, at, parts = (fresh(c, [*RESULT, *keep, th]) for c in ("_doc", "_at", "_parts"))
    whole = F.col("text")
    words = F.regexp_extract_all(whole, F.lit(r"\s*\S+"), F.lit(0))
    cut = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / top).cast("int")), lambda i: F.array_join(F.slice(w, i * top + 1, top), ""))
    texts = docs.select(F.col(id_col).alias(doc), text.alias("text"), F.xxhash64(text).alias(at)).dropDuplicates([doc, at])
    # The words are bound once and then cut.
    texts = texts.select(doc, at, F.when(word_count("text") <= top, F.array(whole)).otherwise(F.element_at(F.transform(F.array(words), cut), 1)).alias(parts))
    joined = texts.join(out, F.col(doc).eqNullSafe(F.col("doc_id")) & (F.col(at) == F.col(th)))
    return joined.select(*RESULT, *keep, F.get(F.col(parts), F.col("piece").cast("int")).alias("text"))


def _numbered(rows: DataFrame, th: str, total: str, times: str, keep: tuple[str, ...]) -> DataFrame:
    """A row for each copy, with its number ``copy`` among the rows of its id.

    Only where an id has several texts are its rows numbered one after the other;
    there are hardly any of them, and the others need no window.
    """
    copy = lambda before: F.explode(F.sequence(before + 1, before + F.col(times)))
    none = F.lit(0).cast("long")
    several = materialize(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "packing-ids")
    if several.isEmpty():
        return rows.withColumn("copy", copy(none))
    mark, upto = fresh("_several", rows.columns), fresh("_upto", rows.columns)
    named = several.select(F.col("doc_id").alias(mark))
    joined = rows.join(named, F.col("doc_id").eqNullSafe(F.col(mark)), "left_semi")
    # Rows without an id are one id's, so its rows are dealt out by ranges.
    summed, cut = running(joined, ["doc_id"], [F.col(c) for c in (th, total, *keep)], {upto: (F.sum, F.col(times))})
    apart = materialize(summed, "packing-several")
    discard(cut)
    others = rows.join(named, F.col("doc_id").eqNullSafe(F.col(mark)), "left_anti").withColumn("copy", copy(none))
    return apart.withColumn("copy", copy(F.col(upto) - F.col(times))).drop(upto).unionByName(others)
