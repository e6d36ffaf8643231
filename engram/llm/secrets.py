"""Secret scans through a trigram inverted index.

Every rule's regular expression is analysed once into a Boolean query over
case-folded trigrams that any match must contain. Rows come in Arrow batches;
a batch is one index segment: for each trigram that some query names it holds
the posting list of row numbers. Queries are evaluated by intersecting and
uniting postings, and only candidate rows meet the regular expression. A rule
without mandatory trigrams scans all rows. Segments need no shuffle and their
memory is bounded by the batch, and a lost task rebuilds its own segments.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.common import sliced

try:  # the parser's public name changed in 3.11
    from re import _constants as _c
    from re import _parser as _p
except ImportError:  # pragma: no cover
    import sre_constants as _c
    import sre_parse as _p


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have at least ``least`` characters, or the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


_KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")


def _either_case(word: str) -> str:
    # ASCII letters only: IGNORECASE would also let in the long s and the Kelvin sign.
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The three base kinds, in the order in which ties are listed.
BASE_RULES = (
    Rule("assign", rf"({'|'.join(map(_either_case, _KEYWORDS))})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", least=24),
)
#: Further kinds of this engine.
EXTRA_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
)
DEFAULT_RULES = BASE_RULES + EXTRA_RULES

# ---------------------------------------------------------------- trigram queries
# A query is True (no constraint), a trigram, or ("and" | "or", frozenset of queries).

_MOST = 64  # literal strings kept per position before they are turned into trigrams


def _join(op: str, parts) -> object:
    flat = set()
    for q in parts:
        if q is True:
            if op == "or":
                return True
            continue
        flat |= q[1] if isinstance(q, tuple) and q[0] == op else {q}
    if not flat:
        return True
    if op == "or":  # a or (a and b) is a
        parts_of = {q: q[1] if isinstance(q, tuple) else frozenset([q]) for q in flat}
        flat = {q for q in flat if not any(parts_of[o] < parts_of[q] for o in flat)}
    return next(iter(flat)) if len(flat) == 1 else (op, frozenset(flat))


def _need(strings: set[str]) -> object:
    """The query that one of ``strings`` occurs; True if one is too short to tell."""
    return _join("or", (_join("and", (s[i : i + 3] for i in range(len(s) - 2))) for s in strings))


def _members(items) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is _c.LITERAL:
            out.add(chr(arg))
        elif op is _c.RANGE and arg[1] - arg[0] < _MOST:
            out |= {chr(x) for x in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out


def _fold(strings: set[str]) -> set[str]:
    return {"".join(c.lower() if c.isascii() else c for c in s) for s in strings}


def _exact(node) -> set[str] | None:
    """All strings that a parse node can match, case-folded, if they are few; else None."""
    op, arg = node
    if op is _c.LITERAL:
        return _fold({chr(arg)})
    if op is _c.IN:
        m = _members(arg)
        return None if m is None or len(_fold(m)) > 8 else _fold(m)
    if op is _c.AT:
        return {""}
    if op is _c.SUBPATTERN:
        return _exact_all(arg[3])
    if op is _c.BRANCH:
        found = [_exact_all(b) for b in arg[1]]
        return None if None in found else set().union(*found)
    if op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and arg[1] is not _c.MAXREPEAT and arg[1] <= 4:
        one = _exact_all(arg[2])
        if one is None:
            return None
        out: set[str] = set()
        for n in range(arg[0], arg[1] + 1):
            out |= {"".join(x) for x in product(one, repeat=n)}
            if len(out) > _MOST:
                return None
        return out
    return None


def _exact_all(seq) -> set[str] | None:
    out = {""}
    for node in seq:
        e = _exact(node)
        if e is None or len(out) * len(e) > _MOST:
            return None
        out = {a + b for a in out for b in e}
    return out


def _query(seq) -> object:
    """What every match of a sequence must contain: runs of exact nodes give literals."""
    needs, run = [], {""}
    for node in seq:
        e = _exact(node)
        if e is not None and len(run) * len(e) <= _MOST:
            run = {a + b for a in run for b in e}
            continue
        needs.append(_need(run))
        run = {""}
        op, arg = node
        if e is not None:
            run = e
        elif op is _c.SUBPATTERN:
            needs.append(_query(arg[3]))
        elif op is _c.BRANCH:
            needs.append(_join("or", (_query(b) for b in arg[1])))
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and arg[0] > 0:
            needs.append(_query(arg[2]))
    needs.append(_need(run))
    return _join("and", needs)


def trigram_query(pattern: str) -> object:
    """The Boolean query of case-folded trigrams implied by a match of ``pattern``."""
    return _query(_p.parse(pattern))


def trigrams_of(query: object) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


def _evaluate(query: object, postings: dict[str, np.ndarray], every: np.ndarray) -> np.ndarray:
    if query is True:
        return every
    if isinstance(query, str):
        return postings[query]
    found = [_evaluate(q, postings, every) for q in query[1]]
    if query[0] == "or":
        return np.unique(np.concatenate(found))
    found.sort(key=len)
    out = found[0]
    for other in found[1:]:
        if not len(out):
            break
        out = np.intersect1d(out, other, assume_unique=True)
    return out


_UPPER = {i: i + 32 for i in range(65, 91)}


def _verifier(rule: Rule) -> Callable[[str], list[tuple[int, int]]]:
    """Leftmost non-overlapping matches, those that are too short left out."""
    pattern = rule.pattern
    if rule.group == 0 and rule.least and re.fullmatch(r"\[[^\]]+\]\+", pattern):
        # A run of one class is matched whole or not at all, so the least length can go into the pattern.
        pattern = f"{pattern[:-1]}{{{rule.least},}}"
    rx, group, least = re.compile(pattern), rule.group, rule.least

    def find(text: str) -> list[tuple[int, int]]:
        return [m.span() for m in rx.finditer(text) if m.end(group) - m.start(group) >= least]

    return find


def scan_batch(texts: list[str], rules: tuple[Rule, ...], queries: list[object]) -> list[list[tuple[int, int, int]]]:
    """For each text its spans (start, rule number, end) in order."""
    every = np.arange(len(texts))
    wanted = set().union(*map(trigrams_of, queries)) if queries else set()
    postings: dict[str, np.ndarray] = {}
    if wanted:
        folded = [t.translate(_UPPER) if not t.isascii() else t.lower() for t in texts]
        postings = {g: np.fromiter((i for i, t in enumerate(folded) if g in t), np.int64) for g in wanted}
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        find = _verifier(rule)
        for i in _evaluate(query, postings, every):
            out[i] += [(a, k, b) for a, b in find(texts[i])]
    for spans in out:
        spans.sort()
    return out


def scan_secrets(
    docs: DataFrame,
    rules: tuple[Rule, ...] = DEFAULT_RULES,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Spans of secrets in every whole text: ``doc_id, spans`` array of (kind, start, end).

    One row per input row, in code points with exclusive ends, ordered by start
    and then by the order of ``rules``. Null and empty texts have no spans; null
    ids stay null; repeated rows are answered each; other columns are not read.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    kinds = [r.kind for r in rules]
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    id_type = src.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            found = scan_batch(texts, rules, queries)
            spans = pa.array([[{"kind": kinds[k], "start": a, "end": e} for a, k, e in row] for row in found], pa.list_(span))
            yield pa.RecordBatch.from_arrays([b.column(0), spans], names=["doc_id", "spans"])

    return src.mapInArrow(run, f"doc_id {id_type}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def _is_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def digest(spans: DataFrame, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """Counts and digests of ``scan_secrets``; native."""
    listed = lambda kinds: F.array_join(
        F.transform(
            F.filter("spans", lambda s: s["kind"].isin(*kinds)) if kinds else F.col("spans"),
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )
    kinds = [r.kind for r in base]
    return spans.select(
        "doc_id",
        *(F.size(F.filter("spans", _is_kind(k))).cast("long").alias(f"n_{k}") for k in kinds),
        F.sha2(listed(kinds).cast("binary"), 256).alias("base_sha256"),
        listed([]).alias("spans"),
    )


def brute_force(text: str | None, rules: tuple[Rule, ...] = BASE_RULES) -> tuple[list[tuple[str, int, int]], str]:
    """Every rule over the whole text without an index: what tests compare with."""
    found = []
    for k, r in enumerate(rules):
        for m in re.compile(r.pattern).finditer(text or ""):
            if len(m.group(r.group)) >= r.least:
                found.append((m.start(), k, m.end()))
    spans = [(rules[k].kind, a, b) for a, k, b in sorted(found)]
    return spans, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
