"""Vectors in columns of arrays: which take part, and matrices of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    entries = F.forall(F.col(f"`{vector}`"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.col(f"`{vector}`").isNotNull() & F.coalesce(entries, F.lit(False))


def matrices(column: pa.Array, keys: pa.Array | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(key, row numbers, vectors as doubles) for each dimension, or key, in a column without nulls; one key has one dimension."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    sizes = np.diff(offsets)
    of = sizes if keys is None else keys.to_numpy()
    for key in np.unique(of).tolist():
        rows = np.flatnonzero(of == key)
        yield key, rows, values[offsets[rows][:, None] + np.arange(sizes[rows[0]])]


def as_lists(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as an Arrow column of lists."""
    n, d = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d, pa.int32()), pa.array(np.ascontiguousarray(matrix).ravel()))
