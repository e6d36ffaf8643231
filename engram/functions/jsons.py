"""JSON in canonical form, and the scan for memory text in audit details."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.schemas import FORBIDDEN_AUDIT_KEYS


def canonical(value: Any, *, ascii_only: bool = False) -> str:
    """Sorted keys, no spaces; non-finite numbers are refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only, allow_nan=False)


def _refuse(name: str) -> Any:
    raise ValueError(f"non-finite number {name}")


def parse(text: str) -> Any:
    return json.loads(text, parse_constant=_refuse)


def _places(value: Any) -> Iterator[tuple[tuple[str | int, ...], str | int]]:
    """(where, name) of everything that a JSON value holds, level by level."""
    level: list[tuple[tuple[str | int, ...], Any]] = [((), value)]
    while level:
        below = []
        for where, inner in level:
            entries = inner.items() if isinstance(inner, dict) else enumerate(inner) if isinstance(inner, list) else ()
            for name, held in entries:
                yield where, name
                below.append(((*where, name), held))
        level = below


def forbidden_path(value: Any) -> str | None:
    """Where a key stands that carries a record's text: of several, the least deep one."""
    for where, name in _places(value):
        if isinstance(name, str) and name in FORBIDDEN_AUDIT_KEYS:
            return "detail" + "".join(f"[{x}]" if isinstance(x, int) else f".{x}" for x in (*where, name))
    return None


def _over_objects(text: str | None, then: Any) -> Any:
    try:
        value = parse(text or "")
    except ValueError:
        return None
    return then(value)


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """Canonical form; null for what is no JSON."""
    return text.map(lambda t: _over_objects(t, canonical))


@F.pandas_udf(T.StringType())
def stored_json(text: pd.Series) -> pd.Series:
    """Canonical form with ASCII escapes, as records keep it."""
    return text.map(lambda t: _over_objects(t, lambda v: canonical(v, ascii_only=True)))


@F.pandas_udf(T.StringType())
def audit_violation(text: pd.Series) -> pd.Series:
    """Null for a text-free object, else what is wrong with the detail."""

    def check(t: str | None) -> str | None:
        try:
            value = parse(t or "")
        except ValueError:
            return "not JSON"
        if not isinstance(value, dict):
            return "not an object"
        return forbidden_path(value)

    return text.map(check)


def is_object(text: F.Column) -> F.Column:
    """Whether the text is a JSON object; native."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))
