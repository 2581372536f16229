"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Blocks (see ``blocks``) carry an upper bound for each query, from a few
orthonormal directions and the length of what they leave over; a query visits
only blocks whose bound reaches its k-th best score so far.  Within a block a
component is kept as its distance from the middle of its dimension's range,
quantised; a posting segment lists the rows of one dimension and distance.  A
group of queries processes segments by descending quantised impact (mean weight
of the group, times step, times distance): a segment adds weight times level to the rows'
accumulators.  What the open segments and the rounding can still change bounds
every score from both sides; each time that has shrunk by a third, queries stop
whose possible members are few, and those are scored exactly.  Whatever the
stopping point, a row left out is proven to score less than k others.

Defined results: vectors that are null or hold null or non-finite components
take no part, nor do null ids; ties go to the smaller id; with fewer than k
candidates all are returned; an empty table gives no rows; columns not named
are not read.  Scores are exact while below 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .neighbours import finite

LEVELS = 32
#: A query stops when at most so many rows of a block, or so small a share of it, may be members.
FEW, FEW_SHARE = 32, 1 / 32
#: How far the room must have shrunk before members are counted again.
SHRUNK = 2 / 3
COORDINATES, SEED = 8, 9


class Block:
    """Posting segments of a block of rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int):
        self.ids, self.rows, self.k = ids, rows.astype(np.float64), k
        low, high = self.rows.min(axis=0), self.rows.max(axis=0)
        self.step = np.maximum(1.0, np.ceil((high - low + 1) / LEVELS))
        self.middle = low + self.step * LEVELS / 2
        level = np.clip((self.rows - low) // self.step, 0, LEVELS - 1).astype(np.int64)
        order = np.argsort(level, axis=0, kind="stable")
        ends = [np.searchsorted(level[order[:, d], d], np.arange(LEVELS + 1)) for d in range(rows.shape[1])]
        self.segments = [[order[e[x] : e[x + 1], d] for x in range(LEVELS)] for d, e in enumerate(ends)]

    def members(self, queries: np.ndarray, k: int, least: np.ndarray | None = None) -> list[np.ndarray]:
        """For each query, the rows that may be among its best k and reach the score ``least``."""
        n, dims = self.rows.shape
        out: list[np.ndarray] = [np.arange(n)] * len(queries)
        if n <= k:
            return out
        least = np.full(len(queries), -np.inf) if least is None else least - queries @ self.middle
        weight = np.abs(queries)
        top = (weight @ self.step).max() * LEVELS
        kind = np.float32 if top < 1e30 else np.float64
        noise = dims * np.finfo(kind).eps * top
        ranks = LEVELS // 2
        open_ = np.full(dims, float(ranks))  # rows of open segments of a dimension are within so many steps of its middle
        impact = (weight.mean(axis=0) * self.step)[:, None] * (np.arange(ranks) + 0.5)
        active, score = np.arange(len(queries)), np.zeros((n, len(queries)), kind)
        looked = room = weight @ (self.step * open_)
        for turn, at in enumerate(np.argsort(-impact, axis=None, kind="stable").tolist(), 1):
            d, rank = divmod(at, ranks)
            for level in (ranks + rank, ranks - 1 - rank):
                if len(rows := self.segments[d][level]):
                    score[rows] += (queries[active, d] * (self.step[d] * (level - ranks + 0.5))).astype(kind)
            open_[d] = max(rank, 0.5)
            last = turn == impact.size
            room = weight[active] @ (self.step * open_) + noise
            if not last and (room > SHRUNK * looked[active]).any():
                continue
            looked[active] = room
            if not last and (2 * room > np.ptp(score, axis=0)).all() and (least[active] == -np.inf).all():
                continue  # nothing can be ruled out yet
            kth = np.maximum(np.partition(score, n - k, axis=0)[n - k] - room, least[active])
            may = score >= kth - room
            done = (may.sum(axis=0) <= max(FEW, FEW_SHARE * n)) | last
            for place in np.flatnonzero(done).tolist():
                out[active[place]] = np.flatnonzero(may[:, place])
            if done.all():
                break
            active, score = active[~done], np.ascontiguousarray(score[:, ~done])
        return out

    def search(self, names: np.ndarray, queries: np.ndarray, least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        queries = queries.astype(np.float64)
        known, times = np.unique(self.ids, return_counts=True)
        at = np.minimum(np.searchsorted(known, names), len(known) - 1)
        own = int(np.where(known[at] == names, times[at], 0).max())  # a query's own rows may be among them, and take no part
        for name, query, found in zip(names.tolist(), queries, self.members(queries, self.k + own, least), strict=True):
            found = found[self.ids[found] != name]
            yield name, self.ids[found], (self.rows[found] @ query).astype(np.int64)


class Products:
    """Vectors seen by a few orthonormal directions and the length of the rest."""

    coordinates = COORDINATES + 1

    def __init__(self, k: int):
        self.k = k

    def project(self, vectors: np.ndarray) -> np.ndarray:
        vectors = vectors.astype(np.float64)
        frame = np.linalg.qr(np.random.default_rng(SEED).standard_normal((vectors.shape[1], COORDINATES)))[0]
        held = vectors @ frame
        rest = np.linalg.norm(vectors - held @ frame.T, axis=1)
        return np.column_stack([held, np.zeros((len(held), COORDINATES - held.shape[1])), rest])

    def bounds(self, queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The greatest products that the boxes allow, with their sign turned."""
        out = -queries[:, -1:] * high[:, -1]
        for j in range(COORDINATES):
            q = queries[:, j : j + 1]
            out -= np.maximum(q * low[:, j], q * high[:, j])
        return out

    def open(self, bounds: np.ndarray, least: np.ndarray) -> np.ndarray:
        return -bounds + 1e-9 * np.abs(bounds) + 1e-6 >= least

    def index(self, ids: np.ndarray, rows: np.ndarray) -> Block:
        return Block(ids, rows, self.k)


def top_products(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k highest integer inner products."""
    vectors = vectors.select(F.col(id_column).alias("vec_id"), F.transform(F.col(vector_column), lambda x: x.cast("double")).alias("x")).where(finite("x"))
    rows = vectors.select("vec_id", F.transform("x", lambda x: F.floor(x * scale)).alias("e"))
    return blocks.best(rows, every, k, Products(k), "long")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score
  FROM p
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
