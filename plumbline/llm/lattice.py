"""Vectors of small integers: how they are made, and exact squared distances between them.

Defined results: vectors that are null, hold null or non-finite components, or a
component whose integer reaches ``LIMIT`` in size (squared distances of 64 such
components may leave a long) take no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .neighbours import finite

LIMIT = 1 << 27
#: Below this size of components distances are exact in double precision, for up to 2^12 components.
EXACT = 1 << 19


def integers(vectors: DataFrame, scale: int, vector_column: str, *others: Column) -> DataFrame:
    """``others`` and ``e``: floor(scale * x) of each component x, for the vectors that take part."""
    x = F.transform(F.col(f"`{vector_column}`"), lambda x: x.cast("double"))
    held = vectors.select(*others, x.alias("e")).where(finite("e"))
    held = held.withColumn("e", F.transform("e", lambda x: F.floor(x * scale).cast("double")))
    return held.where(F.forall("e", lambda x: F.abs(x) < LIMIT)).withColumn("e", F.transform("e", lambda x: x.cast("int")))


def squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points to all centres, as long integers."""
    points, centres = points.astype(np.int64), centres.astype(np.int64)
    if max(np.abs(points).max(initial=0), np.abs(centres).max(initial=0)) < EXACT and points.shape[1] <= 1 << 12:
        p, c = points.astype(np.float64), centres.astype(np.float64)
        return ((p * p).sum(axis=1)[:, None] - 2 * (p @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    out = np.empty((len(points), len(centres)), np.int64)
    for j, centre in enumerate(centres):
        off = points - centre
        out[:, j] = np.einsum("ij,ij->i", off, off)
    return out


def sha256(numbers) -> str:
    """Of integers in decimal, joined by commas, as lowercase hex."""
    return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()
