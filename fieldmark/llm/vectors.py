"""Shared handling of embedding columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import sample_of


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, and every component finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def sample(vectors: DataFrame, column: str, rows: int) -> np.ndarray:
    """At most ``rows`` vectors as doubles, those with the smallest hashes (the same ones at every run)."""
    few = sample_of(vectors.select(column, F.xxhash64(column).alias("hash")), "hash", rows)
    got = few.select(column).toArrow().column(column).combine_chunks()
    return matrix(got)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equally long vectors as a double matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by their largest component first, so no square over- or underflows."""
    x = x / np.abs(x).max(1, keepdims=True) if x.size else x
    return x / np.sqrt((x * x).sum(1, keepdims=True)) if x.size else x
