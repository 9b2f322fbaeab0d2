"""What the vector operators share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """Neither null nor zero, and all components finite numbers."""
    v = v.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def width(rows: DataFrame, column: str) -> int:
    """The most common number of components (of several, the least); vectors of others take no part."""
    got = rows.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return int(got[0]) if got else 0


def matrix(column: pd.Series, d: int) -> np.ndarray:
    """A column of arrays as rows of doubles."""
    return np.stack([np.asarray(x, np.float64) for x in column]) if len(column) else np.zeros((0, d))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled first, so that no square over- or underflows."""
    x = x / np.abs(x).max(1, keepdims=True) if len(x) else x
    return x / np.sqrt((x * x).sum(1, keepdims=True)) if len(x) else x
