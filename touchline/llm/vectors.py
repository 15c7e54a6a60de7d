"""Embedding columns: which rows take part, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_usable(rows: DataFrame, key: str = "vec_id", column: str = "embedding") -> Column:
    """Whether a row takes part: a key, no null or non-finite component, not all zero. Never null."""
    sound = F.forall(column, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(column, lambda x: x != 0)
    return F.coalesce(F.col(key).isNotNull() & F.col(column).isNotNull() & sound, F.lit(False))


def usable_vectors(rows: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Key and vector of the rows that take part, of any dimension."""
    return rows.select(key, column).where(is_usable(rows, key, column))


def dimensions(vectors: DataFrame, column: str = "embedding") -> list[int]:
    """The dimensions of the vectors; they are compared within each. Tables of embeddings have one or a few."""
    return sorted(r.n for r in vectors.select(F.size(column).alias("n")).distinct().collect())


def matrix(column: "pa.Array | pa.ChunkedArray") -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, without overflow or underflow on the way."""
    if not len(m):
        return m
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))
