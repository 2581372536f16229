"""Centroid clustering with Elkan's bounds, exact over integers.

Each vector keeps its cluster, an upper bound of the distance to its own centroid
and a lower bound of that to every centroid, in a table that each round reads
and writes anew.  When centroids move, the bounds are widened by what they moved;
a distance is calculated only if the bounds and the distances between centroids
leave it open.  Bounds are rounded outward after every step and only strict
inequalities skip, so ties are still decided by exact integer distances, to the
smaller number.  A round's centroids come from the sums of the last one and the
vectors that changed their cluster; each task sums its own, so k rows a task
meet and a cluster may hold any share of the rows.  The driver holds the centroids and their
sums alone.

Defined results: see ``lattice`` for vectors that take no part; so do those of
another length.  Null ids come last in the order of hashes, of repeated ids the lesser vector
first; equal rows get equal results, each its own; with fewer vectors than
centroids there are as many centroids; sums that leave a long are null; an empty
table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, lattice

STATE = "vec_id long, e array<int>, was int, cluster int, upper double, lower array<double>, counted int"
#: Vectors of which a task holds the bounds at once.
BATCH = 8192


def above(squares: np.ndarray) -> np.ndarray:
    """At least the roots."""
    return np.nextafter(np.sqrt(squares.astype(np.float64)), np.inf)


def below(squares: np.ndarray) -> np.ndarray:
    """At most the roots."""
    return np.maximum(np.nextafter(np.sqrt(squares.astype(np.float64)), -np.inf), 0.0)


class Bounds:
    """Clusters of a batch of points, the bounds of their distances, and how many distances were calculated."""

    def __init__(self, points: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        self.points, self.cluster, self.upper, self.lower, self.counted = points, cluster, upper, lower, np.zeros(len(points), np.int32)

    @classmethod
    def first(cls, points: np.ndarray, centres: np.ndarray) -> Bounds:
        """From all distances."""
        far = lattice.squared(points, centres)
        cluster = far.argmin(axis=1)
        made = cls(points, cluster, above(far[np.arange(len(points)), cluster]), below(far))
        made.counted[:] = len(centres)
        return made

    def moved(self, before: np.ndarray, now: np.ndarray) -> None:
        """Widen the bounds by what the centroids have moved."""
        off = now.astype(np.int64) - before
        shift = above((off * off).sum(axis=1))
        shift[(off == 0).all(axis=1)] = 0.0
        self.upper = np.nextafter(self.upper + shift[self.cluster], np.inf)
        self.lower = np.maximum(np.nextafter(self.lower - shift, -np.inf), 0.0)

    def assign(self, centres: np.ndarray) -> None:
        """The nearest centroid of every point, ties to the smaller number."""
        between = below(lattice.squared(centres, centres)) / 2  # halving is exact
        apart = between.copy()
        np.fill_diagonal(apart, np.inf)
        open_ = np.flatnonzero(~(self.upper < apart.min(axis=1)[self.cluster]))
        if not len(open_):
            return
        points, cluster = self.points[open_], self.cluster[open_]
        own, sure = np.zeros(len(open_), np.int64), np.zeros(len(open_), bool)
        upper, lower = self.upper[open_], self.lower[open_]
        for j in range(len(centres)):
            may = (cluster != j) & ~(lower[:, j] > upper) & ~(between[cluster, j] > upper)
            late = np.flatnonzero(may & ~sure)
            if len(late):  # the distance to the own centroid, once
                off = points[late].astype(np.int64) - centres[cluster[late]]
                own[late], sure[late] = np.einsum("ij,ij->i", off, off), True
                upper[late], lower[late, cluster[late]] = above(own[late]), below(own[late])
                self.counted[open_[late]] += 1
                may = may & ~(lower[:, j] > upper) & ~(between[cluster, j] > upper)
            at = np.flatnonzero(may)
            if not len(at):
                continue
            far = lattice.squared(points[at], centres[j : j + 1])[:, 0]
            self.counted[open_[at]] += 1
            lower[at, j] = below(far)
            better = (far < own[at]) | ((far == own[at]) & (j < cluster[at]))
            at, far = at[better], far[better]
            cluster[at], own[at], upper[at] = j, far, above(far)
        self.cluster[open_], self.upper[open_], self.lower[open_] = cluster, upper, lower


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(np.arange(0, n * width + 1, width, dtype=np.int32), pa.array(matrix.ravel(), kind))


def _state(batch: pa.RecordBatch, was: np.ndarray, held: Bounds) -> pa.RecordBatch:
    columns = [batch.column(0), batch.column(1), pa.array(was, pa.int32()), pa.array(held.cluster, pa.int32()), pa.array(held.upper), _lists(held.lower, pa.float64()), pa.array(held.counted, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in STATE.split(", ")])


def start(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """STATE of ``rows`` (vec_id, e): all distances calculated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, BATCH):
            yield _state(batch, np.full(batch.num_rows, -1), Bounds.first(_matrix(batch.column(1)), centres))

    return rows.select("vec_id", "e").mapInArrow(run, STATE)


def again(state: DataFrame, before: np.ndarray, now: np.ndarray) -> DataFrame:
    """STATE after the centroids have moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, BATCH):
            was = batch.column(2).to_numpy()
            held = Bounds(_matrix(batch.column(1)), was.copy(), batch.column(3).to_numpy(), _matrix(batch.column(4)).copy())
            held.moved(before, now)
            held.assign(now)
            yield _state(batch, was, held)

    return state.select("vec_id", "e", "cluster", "upper", "lower").mapInArrow(run, STATE)


def _changes(state: DataFrame, k: int, width: int) -> DataFrame:
    """cluster, n, s0, s1, ...: what the vectors that changed their cluster add to it and take from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            points, was, now = _matrix(batch.column(0)).astype(np.int64), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for sign, of in ((1, now), (-1, was)):
                for j in np.unique(of[of >= 0]):
                    n[j] += sign * (of == j).sum()
                    s[j] += sign * points[of == j].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(n), _lists(s, pa.int64())], ["cluster", "n", "s"])

    made = state.where("was <> cluster").select("e", "was", "cluster").mapInArrow(run, "cluster int, n long, s array<long>")
    return made.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("s")[j]).alias(f"s{j}") for j in range(width)))


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dimension: int = 64, scale: int = 64, seed: int = 1, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part.

    ``counted`` tells how many distances the last round calculated for it.
    """
    spark = vectors.sparkSession
    common.ship_package(spark)
    rows = lattice.integers(vectors, scale, vector_column, F.col(f"`{id_column}`").cast("long").alias("vec_id")).where(F.size("e") == dimension)
    rows = common.materialise(rows, "vectors")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(name.asc_nulls_last(), "e").limit(k).select("e").collect()
    result = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, counted int"
    if not first:
        return spark.createDataFrame([], result)
    centres = np.array([r.e for r in first], np.int64)
    n, sums = np.zeros(len(centres), np.int64), np.zeros(centres.shape, np.int64)
    state = common.materialise(start(rows, centres), "bounds")
    for _ in range(rounds):
        for r in _changes(state, len(centres), dimension).collect():  # a row for each centroid
            n[r.cluster] += r.n
            sums[r.cluster] += [r[f"s{j}"] for j in range(dimension)]
        before, centres = centres, np.where((n > 0)[:, None], sums // np.maximum(n, 1)[:, None], centres)
        state = common.materialise(again(state, before, centres), "bounds")

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off = _matrix(batch.column(1)).astype(np.int64) - centres[batch.column(2).to_numpy()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.einsum("ij,ij->i", off, off)), batch.column(3)], ["vec_id", "cluster", "distance", "counted"])

    made = common.materialise(state.select("vec_id", "e", "cluster", "counted").mapInArrow(far, "vec_id long, cluster int, distance long, counted int"), "distances")
    held = {r.cluster: int(r.s) for r in made.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda x: x if x < 1 << 63 else None
    told = [(j, fits(held.get(j, 0)), fits(sum(held.values())), lattice.sha256(c)) for j, c in enumerate(centres.tolist())]
    told = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return made.join(F.broadcast(told), "cluster").select(*(c.split()[0] for c in result.split(", ")))  # k rows


def _sql(k: int = 16, rounds: int = 3, dimension: int = 64, scale: int = 64, seed: int = 1) -> str:
    """The same in DuckDB, without ``counted``."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (
  SELECT num, min_by(c, (far, c)) AS c, min(far) AS far FROM (
    SELECT v.num, b.c, sum((v.x - b.x) * (v.x - b.x))::BIGINT AS far FROM flat v JOIN c{n} b ON v.i = b.i GROUP BY ALL)
  GROUP BY num)""")
        if n < rounds:
            steps.append(f"""c{n + 1} AS MATERIALIZED (
  SELECT b.c, b.i, coalesce(m.x, b.x) AS x FROM c{n} b LEFT JOIN (
    SELECT a.c, v.i, (sum(v.x) - ((sum(v.x) % count(*)) + count(*)) % count(*))::BIGINT // count(*) AS x
    FROM flat v JOIN a{n} a ON v.num = a.num GROUP BY ALL) m
  ON b.c = m.c AND b.i = m.i)""")
    steps = ", ".join(steps)
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, [floor({scale} * x::DOUBLE)::BIGINT for x in embedding] AS e,
    row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, embedding) - 1 AS num
  FROM embeddings
  WHERE len(embedding) = {dimension} AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), flat AS MATERIALIZED (SELECT num, unnest(e) AS x, unnest(range(len(e))) AS i FROM kept),
c0 AS MATERIALIZED (SELECT num AS c, i, x FROM flat WHERE num < {k}),
{steps}, names AS (
  SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c
)
SELECT vec_id, a.c::INTEGER AS cluster, a.far AS distance, sum(a.far) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia,
  sum(a.far) OVER ()::BIGINT AS inertia, centroid_sha256
FROM a{rounds} a JOIN kept USING (num) JOIN names USING (c)
"""


ORACLE_SQL = _sql()
