"""Vector functions in double precision."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.errors import ValidationError


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def well_formed(v: Column, dim: int) -> Column:
    """Not null, ``dim`` finite components, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return v.isNotNull() & (F.size(v) == dim) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def micro_key(cos: Column) -> Column:
    """Cosine in millionths, half to even; null for null and NaN."""
    return F.when(~F.isnan(cos), F.rint(cos * 1_000_000)).cast("long")


def check_query_vector(v: list[float], dim: int | None = None) -> list[float]:
    values = [float(x) for x in v]
    if dim is not None and len(values) != dim:
        raise ValidationError(f"the query vector has {len(values)} components, not {dim}")
    if not values or not all(map(math.isfinite, values)) or not any(values):
        raise ValidationError("the query vector must be finite and not zero")
    return values


@F.pandas_udf(T.BinaryType())
def encode_f4(v: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats, for interchange."""
    return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_f4(b: pd.Series) -> pd.Series:
    return b.map(lambda x: None if x is None or len(x) % 4 else np.frombuffer(x, "<f4").tolist())
