"""Text functions: tokenizer, payloads, the one-line rendering."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: All of the basic plane but Hangul, whose syllables decompose to several letters, and surrogates.
_FOLDED = (range(0xC0, 0xAC00), range(0xE000, 0x10000))


@cache
def _accents() -> tuple[str, str]:
    """Letters that decompose to one base letter and marks, and these bases."""
    source, target = [], []
    for block in _FOLDED:
        for c in map(chr, block):
            d = unicodedata.normalize("NFD", c)
            if len(d) > 1 and not unicodedata.combining(d[0]) and all(unicodedata.combining(x) for x in d[1:]):
                source.append(c)
                target.append(d[0])
    return "".join(source), "".join(target)


@cache
def _marks() -> str:
    """The combining marks."""
    return "".join(c for c in map(chr, range(0x300, 0x10000)) if unicodedata.combining(c))


def fold(text: Column) -> Column:
    """Marks dropped, lower case. Native; Hangul syllables stay composed, on both sides of a search alike.

    ``translate`` deletes the characters of its source that its target has no
    counterpart for: these are the marks. A text of as many bytes as characters
    has neither marks nor accents.
    """
    source, target = _accents()
    plain = F.octet_length(text) == F.length(text)
    return F.lower(F.when(plain, text).otherwise(F.translate(text, source + _marks(), target)))


def tokens(text: Column) -> Column:
    """Runs of letters and digits of the folded text, in order, repeated ones too (native)."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def terms(text: Column) -> Column:
    """Distinct tokens in first-seen order."""
    return F.array_distinct(tokens(text))


def tokenize(text: str) -> list[str]:
    """The general tokenizer: canonical decomposition, marks dropped, lower case, alphanumeric runs."""
    plain = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).lower()
    return "".join(c if c.isalnum() else " " for c in plain).split()


@F.pandas_udf(T.ArrayType(T.StringType()))
def tokens_any_script(text: pd.Series) -> pd.Series:
    """``tokens`` for every script, by Arrow batches."""
    return text.map(lambda t: tokenize(t or ""))


_SPACE = r"[\s\u0085   -     　\u001c-\u001f]+"


def strip(text: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(text, f"^{_SPACE}|{_SPACE}$", "")


def document_payload(topic: Column, summary: Column) -> Column:
    """What is embedded of a record."""
    return F.concat(F.replace(topic, F.lit("-"), F.lit(" ")), F.lit("\n"), strip(summary))


def query_payload(text: Column, prompt: str = "") -> Column:
    """What is embedded of a query; null for a blank one."""
    body = strip(text)
    return F.when(body != "", F.concat(F.lit(prompt), body))


def one_line(text: Column, width: int = 120) -> Column:
    """White space collapsed, cut to ``width`` with an ellipsis of three dots."""
    flat = strip(F.regexp_replace(text, _SPACE, " "))
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width - 3), F.lit("..."))).otherwise(flat)


def recent_line(day: Column, catalog: Column, topic: Column, summary: Column) -> Column:
    return F.concat_ws(" ", day, F.concat(F.lit("["), catalog, F.lit("]"), F.lit(" "), topic, F.lit(":")), one_line(summary))
