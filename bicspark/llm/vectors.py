"""Vectors of a table: which take part, and their form in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str = "embedding") -> Column:
    """Not null, not empty, not zero, and without null or non-finite components."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.coalesce((F.size(x) > 0) & ~bad & F.exists(x, lambda v: v != 0), F.lit(False))


def valid(table: DataFrame) -> DataFrame:
    """``(row_, vec_id, vector)`` of the rows that take part, as doubles."""
    return table.select("row_", "vec_id", F.col("embedding").cast("array<double>").alias("vector"))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def lists(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    offsets = (np.arange(n + 1) * width).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).ravel()))


def directions(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1, also where squares would overflow or vanish."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def rotation(width: int, size: int, seed: int) -> np.ndarray:
    """The first ``width`` rows of a random rotation of ``size`` dimensions."""
    random = np.random.default_rng([seed, width, size])
    q, r = np.linalg.qr(random.standard_normal((size, size)))
    return (q * np.sign(np.diag(r)))[:width]
