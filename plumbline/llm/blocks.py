"""A stated query set against all rows, leaf by leaf of one tree.

Every row has a few *coordinates* that its operator computes.  A kd-tree over
the coordinates, split at the medians of a bounded sample (about ``SAMPLE`` rows
by hash), deals all rows into at most ``MOST_LEAVES`` leaves; the exact box of each
leaf is taken from all its rows.  Boxes bound what a leaf can hold for a query,
so a query visits leaves from the most promising one on, in rounds of growing
numbers, and stops at the first leaf that cannot matter any more for the k-th
best score it has found anywhere.

A leaf is served in blocks of about ``BLOCK_ROWS`` rows, by a hash of the row's number in its
file, so repeated ids and equal vectors fill no block; many visitors are served
in groups.  A task holds one block and reads its visitors as a stream.  Nothing
but the boxes reaches the driver or every task, and no pair of rows is ever a
table row.

Defined results: null ids take no part; vectors meet those of their length
only; a row is never its own id's result; ties go to the smaller id; of
repeated query ids the least vector asks; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SAMPLE, MOST_LEAVES, LEAF_ROWS, BLOCK_ROWS, VISITORS, AT_ONCE = 8192, 1024, 4096, 8192, 16_384, 512
#: Leaves seen after each round; the last is repeated with as many more.
ROUNDS = (1, 4, 16, 64, 256)


class Index(Protocol):
    """One block of rows."""

    def search(self, names: np.ndarray, queries: np.ndarray, least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query id, row ids, scores): all that may be among the query's best k; ``least`` is the k-th best score so far."""


class Space(Protocol):
    """How an operator sees vectors."""

    coordinates: int

    def project(self, vectors: np.ndarray) -> np.ndarray: ...

    def bounds(self, queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of each query (coordinates) and box, a number that is the greater the less the box can hold."""

    def open(self, bounds: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Whether a box at such a bound may still matter."""

    def index(self, ids: np.ndarray, rows: np.ndarray) -> Index: ...


class Planes:
    """A tree of splits; a leaf is the number of the region a point falls into."""

    def __init__(self, points: np.ndarray, leaves: int):
        self.nodes: list[tuple[int, float, int, int]] = []  # dimension, value, next below, next from value on; leaves are ~number
        self.leaves = 0
        self.root = self._split(points, leaves) if len(points) else self._leaf()

    def _leaf(self) -> int:
        self.leaves += 1
        return ~(self.leaves - 1)

    def _split(self, points: np.ndarray, leaves: int) -> int:
        spread = np.ptp(points, axis=0)
        if leaves < 2 or len(points) < 2 or not spread.max() > 0:
            return self._leaf()
        dim = int(spread.argmax())
        value = float(np.quantile(points[:, dim], (leaves // 2) / leaves, method="higher"))
        below = points[:, dim] < value
        if not below.any():
            value = float(np.nextafter(value, np.inf))
            below = points[:, dim] < value
        at = len(self.nodes)
        self.nodes.append((dim, value, 0, 0))
        if below.all():
            self.nodes.pop()
            return self._leaf()
        self.nodes[at] = (dim, value, self._split(points[below], leaves // 2), self._split(points[~below], leaves - leaves // 2))
        return at

    def of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int32)
        stack = [(self.root, np.arange(len(points)))]
        while stack:
            node, held = stack.pop()
            if node < 0:
                out[held] = ~node
            elif len(held):
                dim, value, below, above = self.nodes[node]
                less = points[held, dim] < value
                stack += [(below, held[less]), (above, held[~less])]
        return out


def _matrices(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the vectors of each length."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), n)


def _coordinates(space: Space, vectors: pa.Array) -> np.ndarray:
    out = np.zeros((len(vectors), space.coordinates))
    for at, matrix in _matrices(vectors):
        if matrix.shape[1]:
            out[at] = space.project(matrix)
    return out


def best(rows: DataFrame, every: int, k: int, space: Space, score_type: str) -> DataFrame:
    """query_id, rank, vec_id, score from ``rows`` (vec_id, e: arrays without nulls).

    Queries are the ids divisible by ``every``.
    """
    spark = rows.sparkSession
    common.ship_package(spark)
    kind = dict(rows.dtypes)["e"]
    rows = rows.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "e")
    rows = common.numbered(rows, "vectors", "number")
    total = rows.count()

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(_coordinates(space, batch.column(0))), pa.list_(pa.float64()))], ["p"])

    share = max(1, total // SAMPLE)
    sample = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "number"), F.lit(share)) == 0).select("e").mapInArrow(points, "p array<double>").collect()
    planes = Planes(np.array([r.p for r in sample]).reshape(-1, space.coordinates), min(MOST_LEAVES, -(-total // LEAF_ROWS)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = _coordinates(space, batch.column(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(made), pa.list_(pa.float64())), pa.array(planes.of(made))], [*batch.schema.names, "p", "leaf"])

    placed = common.materialise(rows.mapInArrow(place, f"vec_id long, e {kind}, number long, p array<double>, leaf int"), "placed")
    sides = [f(F.col("p")[j]).alias(f"{n}{j}") for n, f in (("low", F.min), ("high", F.max)) for j in range(space.coordinates)]
    held = placed.groupBy("leaf").agg(F.count("*").alias("n"), *sides).collect()  # at most MOST_LEAVES
    number = [r.leaf for r in held]
    low, high = (np.array([[r[f"{n}{j}"] for j in range(space.coordinates)] for r in held]).reshape(len(held), space.coordinates) for n in ("low", "high"))
    blocks = spark.createDataFrame([(r.leaf, -(-r.n // BLOCK_ROWS)) for r in held], "leaf int, blocks long")
    queries = common.materialise(placed.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("e", "p")).alias("x")).select("query_id", "x.e", "x.p"), "queries")

    def route(seen: int, upto: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in common.slices(batches, AT_ONCE):
                least = np.nan_to_num(batch.column(3).to_numpy(zero_copy_only=False).astype(float), nan=-np.inf)
                far = space.bounds(np.array(batch.column(2).to_pylist()), low, high)
                order = np.argsort(far, axis=1, kind="stable")[:, seen:upto]
                who, at = np.nonzero(space.open(np.take_along_axis(far, order, axis=1), least[:, None]))
                here = pa.array(who)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(number, np.int32)[order[who, at]]), batch.column(0).take(here), batch.column(1).take(here), pa.array(least[who])], ["leaf", "query_id", "e", "least"])

        return run

    found, seen = spark.createDataFrame([], f"query_id long, rank int, vec_id long, score {score_type}"), 0
    better = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    while seen < len(number):
        upto = next((x for x in ROUNDS if x > seen), 2 * seen)
        kth = found.where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("least"))
        visits = queries.join(kth, "query_id", "left").select("query_id", "e", "p", "least").mapInArrow(route(seen, upto), f"leaf int, query_id long, e {kind}, least double")
        visits, seen = common.materialise(visits, "visits"), upto
        counts = visits.groupBy("leaf").agg(F.ceil(F.count("*") / VISITORS).alias("groups")).join(blocks, "leaf")
        if counts.isEmpty():
            break
        new = _serve(placed, visits, F.broadcast(counts), k, space, kind, score_type)  # a row for each leaf
        found = new.unionByName(found.drop("rank")).withColumn("rank", F.row_number().over(better)).where(F.col("rank") <= k)
        found = common.materialise(found.select("query_id", "rank", "vec_id", "score"), "found")
    return found


def _serve(rows: DataFrame, visits: DataFrame, counts: DataFrame, k: int, space: Space, kind: str, score_type: str) -> DataFrame:
    """query_id, vec_id, score: the best k of each block that a query visits."""
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    deal = lambda x, n: F.pmod(F.xxhash64(F.lit("block"), x), F.col(n))
    there = rows.join(counts, "leaf").select("leaf", deal("number", "blocks").alias("block"), spread("groups").alias("group"), F.lit(0).alias("asks"), F.col("vec_id").alias("id"), "e", F.lit(0.0).alias("least"))
    asked = visits.join(counts, "leaf").select("leaf", spread("blocks").alias("block"), deal("query_id", "groups").alias("group"), F.lit(1).alias("asks"), F.col("query_id").alias("id"), "e", "least")
    met = there.unionByName(asked).select(F.size("e").alias("n"), "*")
    key = ["n", "leaf", "block", "group"]
    dealt = met.repartition(4 * common.shuffle_partitions(rows.sparkSession), *key).sortWithinPartitions(*key, "asks")
    result = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64() if score_type == "long" else pa.float64())])

    def answer(index: Index | None, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if index is None or not held:
            return
        out = []
        for name, ids, scores in index.search(*(np.concatenate(x) for x in zip(*held, strict=True))):
            order = np.lexsort((ids, -scores))[:k]
            out.append((np.full(len(order), name), ids[order], scores[order]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(zip(*out, strict=True), result.types, strict=True)], schema=result)

    def serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows_, index, asked_ = None, [], None, []
        for batch in batches:
            keys = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:5]])
            cuts = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if (key := tuple(keys[a, :4])) != now:
                    yield from answer(index, asked_)
                    now, rows_, index, asked_ = key, [], None, []
                part = batch.slice(a, b - a)
                ids, vectors = part.column(5).to_numpy(), part.column(6).flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)
                if keys[a, 4] == 0:
                    rows_.append((ids, vectors))
                    continue
                if rows_:
                    index, rows_ = space.index(*(np.concatenate(x) for x in zip(*rows_, strict=True))), []
                for at in range(0, b - a, AT_ONCE):
                    asked_.append((ids[at : at + AT_ONCE], vectors[at : at + AT_ONCE], part.column(7).to_numpy()[at : at + AT_ONCE]))
                    if sum(len(x[0]) for x in asked_) >= AT_ONCE:
                        yield from answer(index, asked_)
                        asked_ = []
        yield from answer(index, asked_)

    return dealt.mapInArrow(serve, f"query_id long, vec_id long, score {score_type}")
