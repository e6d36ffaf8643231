"""Line dedup by a deletion-neighbourhood join (native).

Two lines are near copies when at most one edit (an inserted, deleted or
replaced character) parts them. Then deleting one character from either line,
or from the longer one only, gives equal variants; equal hashes of variants are
what lines are joined on. To emit a variant for each character of each line
would be far too much, so the neighbourhood is narrowed in levels: a variant
first leaves out a whole block of the line, and only where that variant is
shared with another line are its blocks divided, down to single characters. As
a character's variant lies in its block's, no near copy is lost on the way.

Positions are those of the longer line: a line of n characters takes part as
itself (length n) and as the shorter partner of lines of n+1. At the last level
all members of a group are within one edit of each other, so each is compared
with the group's earliest line only, and cost stays linear in group size.
Levels aggregate two numbers a key before the shuffle; no group is gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.common import among, discard, fresh, materialize, text_or_empty

FIRST_BLOCKS, BLOCKS = 2, 16


def _variant(line: Column, n: Column, target: Column, begin: Column, end: Column) -> Column:
    """Hash of ``line`` without positions [begin, end) of a line of ``target`` characters."""
    right = F.substr(line, end + F.when(target == n, F.lit(1)).otherwise(F.lit(0)))
    return F.xxhash64(target, begin, end, F.substr(line, F.lit(1), begin), right)


def _divided(rows: DataFrame, parts: int) -> DataFrame:
    """Rows ``lid, n, line, target, begin, end`` by block; out: one row for each part with its variant's hash."""
    width = (F.col("end") - F.col("begin")).cast("long")
    edge = lambda k: (F.col("begin") + F.floor(width * k / parts)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.struct(edge(k).alias("b"), edge(k + 1).alias("e")))
    cut = rows.select("lid", "n", "line", "target", F.explode(F.filter(blocks, lambda x: x["e"] > x["b"])).alias("x"))
    return cut.select("lid", "target", F.col("x.b").alias("begin"), F.col("x.e").alias("end"), _variant(F.col("line"), F.col("n"), F.col("target"), F.col("x.b"), F.col("x.e")).alias("variant"))


_KEY = ["variant", "target", "begin", "end"]


def _shared(rows: DataFrame) -> DataFrame:
    """Those rows whose variant another line has, too.

    Few rows do, so a Bloom filter of the shared variants goes before the join
    and hardly any row is shuffled a second time.
    """
    keys = materialize(rows.groupBy(*_KEY).agg(F.min("lid").alias("_lo"), F.max("lid").alias("_hi")).where("_lo <> _hi").select(*_KEY), "line-variants")
    return among(rows, keys, *_KEY)[0]


def _first_division(lines: DataFrame) -> DataFrame:
    """Each line with its own length as target and with the next one, in FIRST_BLOCKS parts.

    The variants are hashed before rows are made of them, so no text is copied.
    """
    cuts = []
    for target in (F.col("n"), F.col("n") + 1):
        for k in range(FIRST_BLOCKS):
            begin, end = (F.floor(target.cast("long") * i / FIRST_BLOCKS).cast("int") for i in (k, k + 1))
            cuts.append(F.struct(target.alias("target"), begin.alias("begin"), end.alias("end"), _variant(F.col("line"), F.col("n"), target, begin, end).alias("variant")))
    return lines.select("lid", F.explode(F.array(*cuts)).alias("x")).select("lid", "x.*")


def near_copies(lines: DataFrame, *, min_chars: int) -> DataFrame:
    """From distinct lines ``pos, line``: the ``pos`` of lines with an earlier one within one edit."""
    long = lines.select(F.xxhash64("line").alias("lid"), "pos", "line", F.length("line").alias("n")).where(F.col("n") >= min_chars)
    found = materialize(_shared(_first_division(long)), "line-suspects")
    lids = found.select("lid").distinct()
    texts = materialize(among(long, lids, "lid")[0], "line-texts")
    done = []
    while True:
        done.append(found.where(F.col("end") - F.col("begin") == 1))
        wider = found.where(F.col("end") - F.col("begin") > 1)
        if wider.isEmpty():
            break
        blocks = wider.select("lid", "target", "begin", "end").join(texts, "lid").select("lid", "n", "line", "target", "begin", "end")
        found = materialize(_shared(_divided(blocks, BLOCKS)), "line-suspects")
    pairs = reduce(DataFrame.unionByName, done).select("lid", *_KEY).join(texts, "lid")
    earliest = pairs.groupBy(*_KEY).agg(F.min(F.struct("pos", "line")).alias("first"))
    linked = pairs.join(earliest, _KEY).where((F.col("first.pos") < F.col("pos")) & (F.levenshtein(F.col("line"), F.col("first.line"), 1) >= 0))
    return linked.select("pos").distinct()


def dedup_lines(docs: DataFrame, *, min_chars: int = 16, near: bool = True, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_dropped_lines") -> DataFrame:
    """``docs`` without repeated lines, and how many lines each row lost.

    Lines are parted by LF and ordered by (id, line number). Of equal lines the
    earliest stays. A line of ``min_chars`` or more characters also goes when any
    earlier line, kept or not, is within one edit of it; shorter ones only when
    equal. Blank lines (nothing but spaces and controls) always stay. Rows with
    equal id and text lose the same lines; rows with equal ids and other texts
    are ordered by a hash of the text; null ids come last. A null text stays
    null. A clashing ``count_col`` is lengthened by underscores.
    """
    count_col = fresh(count_col, docs.columns)
    taken = [*docs.columns, count_col]
    doc, th, kept, blanks, of, at = (fresh(c, taken) for c in ("_doc", "_th", "_kept", "_blanks", "_of", "_at"))
    text = text_or_empty(text_col)
    keyed = docs.withColumn(doc, F.col(id_col).cast("long")).withColumn(th, F.xxhash64(text))
    blank = lambda line: line.rlike(r"^[\s\p{Cntrl}]*$")
    lines = keyed.select(doc, th, F.posexplode(F.split(text, "\n")).alias("no", "line")).where(~blank(F.col("line")))
    pos = F.struct(F.col(doc).isNull().alias("last"), F.col(doc).alias("doc"), F.col("no"), F.col(th).alias("th"))
    distinct = materialize(lines.groupBy("line").agg(F.min(pos).alias("pos")), "lines")
    stay = distinct.select("pos")
    if near:
        stay = stay.join(near_copies(distinct, min_chars=min_chars), "pos", "left_anti")
    stay = materialize(stay, "line-stay")
    discard(distinct)
    by_row = stay.groupBy(F.col("pos.doc").alias(of), F.col("pos.th").alias(at)).agg(F.collect_list("pos.no").alias(kept))
    # The lines themselves pass through the join in the text's place, so that they are split once.
    split = F.split(F.col(text_col), "\n")
    numbered = F.transform(split, lambda line, i: F.when(blank(line), i))
    rows = keyed.withColumn(blanks, F.filter(numbered, lambda i: i.isNotNull())).withColumn(text_col, split)
    joined = rows.join(by_row, F.col(doc).eqNullSafe(F.col(of)) & (F.col(th) == F.col(at)), "left")
    none = F.array().cast("array<int>")
    staying = F.array_sort(F.array_union(F.coalesce(F.col(kept), none), F.col(blanks)))
    return (
        joined.withColumn(kept, staying)
        .withColumn(count_col, F.coalesce(F.size(text_col) - F.size(kept), F.lit(0)).cast("long"))
        .withColumn(text_col, F.when(F.col(count_col) == 0, F.array_join(text_col, "\n")).otherwise(F.array_join(F.transform(F.col(kept), lambda i: F.get(F.col(text_col), i)), "\n")))
        .select(*docs.columns, count_col)
    )
