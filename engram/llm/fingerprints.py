"""Document fingerprints by content-defined chunking.

A gear hash runs over the UTF-8 bytes; a chunk ends where its low bits vanish.
Normalised chunking asks for more zero bits before the normal size and for
fewer after it, which narrows the spread of sizes. As the hash sees 32 bytes
only and no chunk is shorter, boundaries depend on nearby text alone and an
edit moves no boundary further on. A fingerprint is the set of distinct chunk
digests, each weighted by its chunk's length; containment of two texts is the
shared weight over the smaller total weight.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import parallelism, sliced, text_or_empty

MIN_SIZE, NORMAL_SIZE, MAX_SIZE = 32, 96, 384
STRICT_BITS, LOOSE_BITS = 8, 5
_BLOCK = 1 << 22  # bytes hashed at once


def _gear() -> np.ndarray:
    """256 numbers from a fixed rule: the multiply-and-shift mix of each byte value."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def gear_hash(data: np.ndarray) -> np.ndarray:
    """At each byte: the sum of the gear values of the last 32 bytes, each shifted by its age."""
    h = GEAR[data]
    for s in (1, 2, 4, 8, 16):
        older = h[:-s] << np.uint32(s)
        h[s:] += older
    return h


def cut(data: bytes) -> list[int]:
    """Ends of the chunks of one text."""
    return _cuts([data])[0]


def _cuts(blobs: list[bytes]) -> list[list[int]]:
    # The first MIN_SIZE bytes of a text are never looked at, so neighbours in the buffer cannot be seen.
    h = gear_hash(np.frombuffer(b"".join(blobs), np.uint8))
    loose = np.flatnonzero(h & np.uint32((1 << LOOSE_BITS) - 1) == 0)
    strict = loose[h[loose] & np.uint32((1 << STRICT_BITS) - 1) == 0]
    ends = np.cumsum([len(b) for b in blobs])
    out, begin = [], 0
    at_l, at_s = np.searchsorted(loose, ends).tolist(), np.searchsorted(strict, ends).tolist()
    i = j = 0
    for k, end in enumerate(ends.tolist()):
        out.append(_choose(end - begin, (strict[j : at_s[k]] + 1 - begin).tolist(), (loose[i : at_l[k]] + 1 - begin).tolist()))
        i, j, begin = at_l[k], at_s[k], end
    return out


def _choose(n: int, strict: list[int], loose: list[int]) -> list[int]:
    cuts, start = [], 0
    while n - start > MIN_SIZE:
        at = bisect_left(strict, start + MIN_SIZE)
        if at < len(strict) and strict[at] < start + NORMAL_SIZE:
            start = strict[at]
        else:
            at = bisect_left(loose, start + NORMAL_SIZE)
            stop = loose[at] if at < len(loose) else n
            start = min(stop, start + MAX_SIZE, n)
        cuts.append(start)
    if start < n:
        cuts.append(n)
    return cuts


def chunk_sets(texts: list[str]) -> list[dict[int, int]]:
    """For each text, digest -> length of its distinct chunks."""
    out: list[dict[int, int]] = []
    blobs: list[bytes] = []
    size = 0
    digest = xxhash.xxh3_64_intdigest

    def flush() -> None:
        for b, cuts in zip(blobs, _cuts(blobs), strict=True):
            start, found = 0, {}
            for end in cuts:
                found[digest(b[start:end])] = end - start
                start = end
            out.append(found)
        blobs.clear()

    for t in texts:
        blobs.append(t.encode("utf-8", "surrogatepass"))
        size += len(blobs[-1])
        if size >= _BLOCK:
            flush()
            size = 0
    if blobs:
        flush()
    return out


def encode(chunks: dict[int, int]) -> str:
    """Base64 of the sorted digests (8 bytes each) and of their lengths (2 bytes each)."""
    keys = np.array(sorted(chunks), "<u8")
    sizes = np.array([chunks[k] for k in keys.tolist()], "<u2")
    return "cdc1:" + base64.b64encode(keys.tobytes() + sizes.tobytes()).decode()


def decode(fingerprint: str) -> dict[int, int]:
    raw = base64.b64decode(fingerprint.removeprefix("cdc1:"))
    n = len(raw) // 10
    return dict(zip(np.frombuffer(raw[: 8 * n], "<u8").tolist(), np.frombuffer(raw[8 * n :], "<u2").tolist(), strict=True))


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Shared weight over the smaller total; two empty sets are alike, an empty and another not."""
    if not a or not b:
        return float(not a and not b)
    if len(a) > len(b):
        a, b = b, a
    shared = sum(w for k, w in a.items() if k in b)
    return min(1.0, shared / min(sum(a.values()), sum(b.values())))


def edited(text: str, following: str) -> str:
    """The last half (rounded down) of ``text`` replaced by as much of the start of ``following``."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, fingerprint`` of every whole text, one row per input row.

    Null texts count as empty and get the fingerprint of the empty set. Null ids
    stay null; repeated rows are answered each; other columns are not read.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("_text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = b.column(1).to_pylist()
            prints = [encode(c) for c in chunk_sets(texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(prints, pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    return src.mapInArrow(run, f"doc_id {kind}, n_chars bigint, fingerprint string")


def _deal_in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows ``doc_id, _h, _text, _bucket, _guest`` sorted so that each one's successor follows it.

    Ranges of ids come from quantiles over all rows; each range is one partition.
    The first row of each range is also a guest at the end of the range before
    it (that of the first range at the end of the last), so the text is shuffled
    once and no window runs over the whole table.
    """
    spark = docs.sparkSession
    n = parallelism(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("_h"), text_or_empty(text_col).alias("_text"))
    points = src.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0]
    splits = np.array(sorted(set(points or [])), np.int64)
    last = len(splits) + 1  # the range of null ids

    def bucket_of(ids, missing):
        return np.where(missing, last, np.searchsorted(splits, np.where(missing, 0, ids), side="right"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            at = bucket_of(ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([ids, b.column(1), pa.array(at, pa.int32())], names=["doc_id", "_h", "_bucket"])

    firsts = (
        src.select("doc_id", "_h")
        .mapInArrow(number, "doc_id bigint, _h bigint, _bucket int")
        .groupBy("_bucket")
        .agg(F.min(F.struct("doc_id", "_h")).alias("first"))
        .orderBy("_bucket")
        .collect()  # one row a range
    )
    before = {(r["first"]["doc_id"], r["first"]["_h"]): (r["_bucket"], firsts[i - 1]["_bucket"]) for i, r in enumerate(firsts)}
    heads = {h for _, h in before}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            at = bucket_of(ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False))
            guests = [(i, before[key][1]) for i, h in enumerate(b.column(1).to_pylist()) if h in heads and (key := (ids[i].as_py(), h)) in before]
            take = pa.array([*range(b.num_rows), *(i for i, _ in guests)], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(take) for c in range(3)), pa.array([*at.tolist(), *(g for _, g in guests)], pa.int32()), pa.array([False] * b.num_rows + [True] * len(guests))],
                names=["doc_id", "_h", "_text", "_bucket", "_guest"],
            )

    dealt = src.mapInArrow(deal, "doc_id bigint, _h bigint, _text string, _bucket int, _guest boolean")
    return dealt.repartitionById(last + 1, F.col("_bucket")).sortWithinPartitions("_bucket", "_guest", F.col("doc_id").asc_nulls_last(), "_h")


def compare_with_edit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edit (see ``edited``), and their likeness.

    The next document is the one with the next id, after the last one the first.
    Null ids follow all others; rows with the same id are ordered by a hash of
    their text, and identical rows follow each other. A single row follows itself.
    Null texts count as empty. Output: ``doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row whose successor has not come yet
        for b in sliced(batches):
            rows = list(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True))
            sets = chunk_sets([r[1] for r in rows])
            done = []
            for (doc, text, bucket, guest), chunks in zip(rows, sets, strict=True):
                if held is not None and held[3] == bucket:
                    done.append((*held[:3], edited(held[1], text), containment(held[2], chunks)))
                held = None if guest else (doc, text, chunks, bucket)
            other = chunk_sets([d[3] for d in done])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([d[0] for d in done], pa.int64()),
                    pa.array([len(d[1]) for d in done], pa.int64()),
                    pa.array([hashlib.sha256(d[3].encode("utf-8", "surrogatepass")).hexdigest() for d in done], pa.string()),
                    pa.array([encode(d[2]) for d in done], pa.string()),
                    pa.array([encode(e) for e in other], pa.string()),
                    pa.array([containment(d[2], e) for d, e in zip(done, other, strict=True)], pa.float64()),
                    pa.array([d[4] for d in done], pa.float64()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return _deal_in_order(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
