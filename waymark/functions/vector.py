"""Vector arithmetic in double precision on array columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))
    return F.when(n > 0, F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v))


def truncated(v: Column, size: int) -> Column:
    """The first `size` components at unit length; null for shorter vectors."""
    return F.when(F.size(v) >= size, normalized(F.slice(v, 1, size)))


def power(cosine: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), (cosine + 1) / 2 * 100))


def softmax(v: Column) -> Column:
    e = F.transform(doubles(v), lambda x: F.exp(x - F.array_max(doubles(v))))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def floats(blob: Column) -> Column:
    """Little-endian 32-bit floats in a binary column, as array<float>; an incomplete last one is left out."""

    def read(col: pd.Series) -> pd.Series:
        return col.map(lambda b: np.frombuffer(b, "<f4", len(b) // 4), na_action="ignore")

    return F.pandas_udf(read, "array<float>")(blob)


def blob(v: Column) -> Column:
    """The reverse of floats()."""

    def write(col: pd.Series) -> pd.Series:
        return col.map(lambda x: np.asarray(x, "<f4").tobytes(), na_action="ignore")

    return F.pandas_udf(write, "binary")(v.cast("array<float>"))
