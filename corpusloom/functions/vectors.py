"""Vector functions as column expressions in double precision."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine within [-1, 1]; null if a vector is zero or the lengths differ."""
    raw = F.try_divide(dot(a, b), norm(a) * norm(b))
    return F.when((F.size(a) == F.size(b)) & raw.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)))


def is_valid(v: Column, dim: int) -> Column:
    """Of the length, finite throughout and not zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


@pandas_udf(StringType())
def digest(v: pd.Series) -> pd.Series:
    """SHA-256 of a vector's little-endian doubles."""
    return v.map(lambda x: None if x is None else hashlib.sha256(np.asarray(x, dtype="<f8").tobytes()).hexdigest())
