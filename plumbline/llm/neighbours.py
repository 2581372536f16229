"""Approximate nearest neighbours by low-dimensional stable projections and a kd-tree.

Vectors of length one are projected on DIRECTIONS Gaussian directions.  For
points at distance d the squared projected distance over d^2 is chi-squared with
as many degrees of freedom, whatever the dimension.  The projections of all rows
are indexed by a kd-tree: its upper levels deal the rows into leaves (see
``blocks``), its lower ones stand in each block.  A query takes its projected
neighbours in ascending order, leaf by leaf, verifies them on the original
vectors, and stops once the chi-square test says that a point nearer than the
k-th best found so far would have been met by now with probability CONFIDENCE; the
same test tells it which leaves are left to visit.  Every row is indexed.

Defined results: vectors that are null, zero, empty, or hold null or
non-finite components take no part, nor do null ids; equal vectors tie to the
smaller id; with fewer than k candidates all that are found are returned; an
empty table gives no rows; columns not named are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks

DIRECTIONS, CONFIDENCE, LEAF, FIRST_LEAVES, SEED = 32, 0.85, 64, 4, 5


def chi_square_quantile(p: float, freedom: int) -> float:
    """Wilson and Hilferty's approximation."""
    spread = 2 / (9 * freedom)
    return freedom * (1 - spread + NormalDist().inv_cdf(p) * math.sqrt(spread)) ** 3


class KdTree:
    """Leaves of points split at the median of the widest direction, with their boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaves, stack = points, [], [np.arange(len(points))]
        while stack:
            held = stack.pop()
            spread = np.ptp(points[held], axis=0)
            if len(held) <= leaf or not spread.max() > 0:
                self.leaves.append(held)
                continue
            half = len(held) // 2
            order = np.argpartition(points[held, spread.argmax()], half)
            stack += [held[order[:half]], held[order[half:]]]
        self.low = np.array([points[x].min(axis=0) for x in self.leaves])
        self.high = np.array([points[x].max(axis=0) for x in self.leaves])

    def ascending(self, query: np.ndarray) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """(bound, points, their distances): batches in ascending order; all later points are at ``bound`` or beyond. All squared."""
        gap = np.maximum(np.maximum(self.low - query, query - self.high), 0)
        bounds = (gap * gap).sum(axis=1)
        order = np.argsort(bounds, kind="stable")
        near, far, at, take = np.empty(0, int), np.empty(0), 0, FIRST_LEAVES
        while at < len(order):
            own = np.concatenate([self.leaves[n] for n in order[at : at + take]])
            off = self.points[own] - query
            near, far = np.concatenate([near, own]), np.concatenate([far, np.einsum("ij,ij->i", off, off)])
            at, take = at + take, 2 * take
            bound = bounds[order[at]] if at < len(order) else np.inf
            ready = far <= bound
            if ready.any():
                yield bound, near[ready], far[ready]
                near, far = near[~ready], far[~ready]


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # so that no square overflows
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


class Block:
    """The kd-tree of a block of rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int, confidence: float):
        self.ids, self.rows, self.k, self.limit = ids, _unit(rows), k, chi_square_quantile(confidence, DIRECTIONS)
        self.directions = directions(rows.shape[1])
        self.tree = KdTree(self.rows @ self.directions)

    def search(self, names: np.ndarray, queries: np.ndarray, least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        queries, k = _unit(queries), self.k
        for name, query, shadow, kth in zip(names.tolist(), queries, queries @ self.directions, least.tolist(), strict=True):
            found, scores = np.empty(0, int), np.empty(0)
            stop = self.limit * max(0.0, 2 - 2 * kth)
            for bound, batch, far in self.tree.ascending(shadow):
                batch = batch[(far < stop) | (far == 0)]
                batch = batch[self.ids[batch] != name]
                found, scores = np.concatenate([found, batch]), np.concatenate([scores, self.rows[batch] @ query])
                if len(found) >= k:
                    kth = max(kth, float(np.partition(scores, len(scores) - k)[len(scores) - k]))
                    stop = self.limit * max(0.0, 2 - 2 * kth)
                if bound >= stop:
                    break
            yield name, self.ids[found], scores


def directions(dimension: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dimension, DIRECTIONS))


class Projections:
    """Vectors seen by their projections."""

    coordinates = DIRECTIONS

    def __init__(self, k: int, confidence: float = CONFIDENCE):
        self.k, self.confidence = k, confidence

    def project(self, vectors: np.ndarray) -> np.ndarray:
        return _unit(vectors) @ directions(vectors.shape[1])

    def bounds(self, queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Squared distances to the boxes."""
        out = np.zeros((len(queries), len(low)))
        for j in range(self.coordinates):
            q = queries[:, j : j + 1]
            gap = np.maximum(np.maximum(low[:, j] - q, q - high[:, j]), 0)
            out += gap * gap
        return out

    def open(self, bounds: np.ndarray, least: np.ndarray) -> np.ndarray:
        stop = chi_square_quantile(self.confidence, DIRECTIONS) * np.maximum(0.0, 2 - 2 * least)
        return (bounds < stop) | (bounds == 0)

    def index(self, ids: np.ndarray, rows: np.ndarray) -> Block:
        return Block(ids, rows, self.k, self.confidence)


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (cosine) of the k nearest found."""
    e = F.transform(F.col(vector_column), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_column).alias("vec_id"), e.alias("e")).where(finite("e") & F.exists("e", lambda x: x != 0))
    return blocks.best(rows, every, k, Projections(k), "double")


def finite(column: str):
    """True for vectors that are not null and hold only finite numbers."""
    return F.col(column).isNotNull() & F.coalesce(F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
