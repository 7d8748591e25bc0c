"""Vectors between Arrow lists and numpy matrices, and which of them take part."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str, scale: float = 1.0, below: float | None = None) -> Column:
    """Whether a vector is there, all its components are finite and, if asked, the square of
    its norm times ``scale`` squared is under ``below``."""
    x = F.transform(vector, lambda c: c.cast("double"))
    fine = F.col(vector).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    if below is not None:
        fine = fine & (F.aggregate(x, F.lit(0.0), lambda s, c: s + c * scale * (c * scale)) < below)
    return F.coalesce(fine, F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, width: int, kind: type = np.float64) -> np.ndarray:
    """Lists without nulls as rows; shorter ones end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=kind)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def lists(rows: np.ndarray) -> pa.Array:
    """A row's values, whatever its shape, as one list."""
    flat = rows.reshape(len(rows), -1)
    return pa.ListArray.from_arrays(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1], flat.ravel())
