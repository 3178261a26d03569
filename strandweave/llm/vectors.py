"""Vectors of Arrow list columns as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(embedding: str = "embedding") -> Column:
    """True where the vector is neither null nor holds null, NaN or infinite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.col(embedding).isNotNull() & ~F.coalesce(F.exists(embedding, bad), F.lit(False))


def matrix(column: pa.Array, dim: int, dtype=np.float64) -> np.ndarray:
    """Rows of a list array without nulls; shorter vectors are filled with zeros up to ``dim``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = np.zeros((len(column), dim), dtype)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat) == out.size:
        return flat.reshape(out.shape)
    row = np.repeat(np.arange(len(size)), size)
    begin = np.repeat(np.cumsum(size) - size, size)
    out[row, np.arange(len(flat)) - begin] = flat
    return out
