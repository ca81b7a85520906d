"""Helpers for tables of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not zero, every component finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def sample(vectors: DataFrame, rows: int, id_: str = "vec_id", vector: str = "embedding") -> np.ndarray:
    """At most ``rows`` usable vectors of the commonest length, chosen by a hash of the id."""
    found = vectors.where(usable(F.col(vector))).select(F.xxhash64(id_).alias("h"), F.col(vector).alias("v")).sort("h", "v").limit(rows).collect()
    if not found:
        return np.zeros((0, 0))
    lengths = [len(r["v"]) for r in found]
    d = max(sorted(set(lengths)), key=lengths.count)
    return np.array([r["v"] for r in found if len(r["v"]) == d], np.float64)


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A list column whose lists all have ``d`` values."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)
