"""Vectors of Arrow columns as matrices, and ids of numpy blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def usable(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is not null, holds finite numbers only and is not zero, as array<double>."""
    v = F.col(vector).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return table.withColumn(vector, v).filter(F.coalesce(good, F.lit(False)))


def alike(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows whose vectors have the table's most frequent length (of equally frequent ones the largest)."""
    n = F.size(vector).alias("n")
    common = rows.groupBy(n).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.filter(F.size(vector) == common.n) if common else rows


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Equal-length lists as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Centres of ``x``; at most as many as it has distinct rows."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    step = max(1, (1 << 23) // len(c)) if len(c) else 1
    for _ in range(rounds):
        near = np.concatenate([((c**2).sum(1) - 2 * x[i : i + step] @ c.T).argmin(1) for i in range(0, len(x), step)])
        n = np.bincount(near, minlength=len(c))
        for j in range(c.shape[1]):
            c[:, j] = np.where(n > 0, np.bincount(near, x[:, j], minlength=len(c)) / np.maximum(n, 1), c[:, j])
    return c
