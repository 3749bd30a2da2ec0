"""Vectors as integer matrices: what operators 11 to 13 share.

A task reads an Arrow column of vectors as one matrix a length, floors it to integers and
adds up exactly: in 64 bits where the sizes prove that nothing overflows, else on Python
integers. Integers are held within plus and minus ``LIMIT``.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: integers of vectors stay within these bounds, sums of 64 bits below SAFE
LIMIT, SAFE = 1 << 58, 1 << 62
LONG = (1 << 63) - 1
DECIMAL = pa.decimal128(38, 0)


def usable_vectors(embeddings: DataFrame, vector_col: str, **others: Column) -> DataFrame:
    """``others`` and v (array of double) of the rows whose vector is there and holds neither
    null nor non-finite components. Only named columns are read, so others cannot clash."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return embeddings.select(*[c.alias(name) for name, c in others.items()], v.alias("v")).where(F.coalesce(fine, F.lit(False)))


def by_length(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the batch, matrix) of the vectors of each length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, flat[starts[rows][:, None] + np.arange(d)].reshape(len(rows), d)


def floors(matrix: np.ndarray, scale: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * matrix.astype(float)), -LIMIT, LIMIT).astype(np.int64)


def largest(*matrices: np.ndarray) -> int:
    return max((int(np.abs(m).max()) for m in matrices if m.size), default=0)


def roomy(matrix: np.ndarray, bound: int) -> np.ndarray:
    """The matrix, on Python integers if what is computed from it may reach ``bound`` beyond 64 bits."""
    return matrix if bound < SAFE else matrix.astype(object)


def column_sums(matrix: np.ndarray) -> np.ndarray:
    return roomy(matrix, largest(matrix) * max(1, len(matrix))).sum(axis=0).astype(object)


def decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], DECIMAL)


def longs(values) -> pa.Array:
    """Exact integers; null where one is beyond a long."""
    if isinstance(values, np.ndarray) and values.dtype == np.int64:
        return pa.array(values)
    return pa.array([int(v) if abs(int(v)) <= LONG else None for v in values], pa.int64())
