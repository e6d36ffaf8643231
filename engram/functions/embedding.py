"""Embedders. A model is a callable from texts to unit vectors; one that needs no files is here."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.errors import ValidationError
from engram.functions.text import tokenize


class Embedder(Protocol):
    dimension: int

    def __call__(self, texts: Sequence[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed token hashing: deterministic, no model files. Texts without tokens get the first unit vector."""

    def __init__(self, dimension: int = 64) -> None:
        self.dimension = dimension

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for row, text in zip(out, texts, strict=True):
            for token in tokenize(text):
                h = xxhash.xxh3_64_intdigest(token)
                row[h % self.dimension] += 1.0 if h >> 63 else -1.0
        norms = np.linalg.norm(out, axis=1)
        out[norms == 0, 0] = 1.0
        return out / np.where(norms == 0, 1, norms)[:, None]


def check_output(v: np.ndarray, dimension: int) -> np.ndarray:
    """Finite unit vectors of the right size."""
    v = np.asarray(v, np.float32)
    if v.ndim != 2 or v.shape[1] != dimension or not np.isfinite(v).all() or (len(v) and np.abs(np.linalg.norm(v, axis=1) - 1).max() > 1e-3):
        raise ValidationError("an embedder must give finite unit vectors of its dimension")
    return v


def embed(text: Column, embedder: Embedder | None = None) -> Column:
    """Vectors by Arrow batches."""
    model = embedder or HashingEmbedder()

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(list(check_output(model(list(s.fillna(""))), model.dimension)))

    return run(text)


def token_budget(text: Column, budget: int, counter: Callable[[str], int] | None = None) -> Column:
    """Whether a text keeps within its budget of tokens; tokens are words unless ``counter`` says otherwise."""
    count = counter or (lambda t: len(tokenize(t)))

    @F.pandas_udf(T.BooleanType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: count(t or "") <= budget)

    return run(text)
