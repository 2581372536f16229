"""Vector code compression by weighted Lloyd over distinct parts.

A vector of integers is cut into equal parts; each part position has a codebook.
Equal parts of a position are one row with a weight: first within a batch of
vectors, so that a part which a third of all vectors share crosses the network
once a batch, then over all of them.  Lloyd's rounds run over those weighted
distinct rows; every task sums its rows by codebook entry, so a round brings
at most ``entries`` rows a position and task together, and the codebooks
(entries * length integers) are all that the driver holds.  Codes and errors are
joined back to the batches by part, and put together batch by batch.

Defined results: see ``lattice`` for vectors that take no part; so do those that
have another length than the commonest multiple of ``parts`` (ties: the smaller).  Null ids
count as the greatest, of repeated ids the lesser vector is first; equal rows
get equal results, each its own; with fewer vectors than entries there are as
many entries as vectors; sums that leave a long are null; an empty table gives
no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, lattice

#: Vectors whose parts are made distinct, and whose codes are put together, at once.
BATCH = 4096
RESULT = "vec_id long, label {label}, code string, error long"


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def split(vectors: DataFrame, parts: int) -> DataFrame:
    """block, position, part, weight: the distinct parts of each batch of ``vectors`` (block, e)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, BATCH):
            blocks, matrix = batch.column(0).to_numpy(), _matrix(batch.column(1))
            width = matrix.shape[1] // parts
            for block in np.unique(blocks):
                own = matrix[blocks == block]
                for at in range(parts):
                    values, weights = np.unique(own[:, at * width : (at + 1) * width], axis=0, return_counts=True)
                    n = len(values)
                    part = pa.ListArray.from_arrays(np.arange(0, n * width + 1, width, dtype=np.int32), pa.array(values.ravel(), pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(np.full(n, at, np.int32)), part, pa.array(weights.astype(np.int64))], ["block", "position", "part", "weight"])

    return vectors.select("block", "e").mapInArrow(run, "block long, position int, part array<int>, weight long")


def _nearest(batch: pa.RecordBatch, books: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """position, places in the batch, parts, their nearest entries (ties to the lower) and distances; columns 0, 1 are position, part."""
    positions, values = batch.column(0).to_numpy(), _matrix(batch.column(1))
    for at in np.unique(positions).tolist():
        held = np.flatnonzero(positions == at)
        far = lattice.squared(values[held], books[at])
        best = far.argmin(axis=1)
        yield at, held, values[held], best, far[np.arange(len(held)), best]


def _sums(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """position, entry, n, s: weight and weighted sum of the parts nearest to each entry."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in common.slices(batches, 1 << 16):
            weights = batch.column(2).to_numpy()
            for at, held, values, best, _ in _nearest(batch, books):
                np.add.at(n[at], best, weights[held])
                np.add.at(s[at], best, values.astype(np.int64) * weights[held][:, None])
        at, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[at, entry]), pa.array(s[at, entry].tolist(), pa.list_(pa.int64()))], ["position", "entry", "n", "s"])

    made = distinct.select("position", "part", "weight").mapInArrow(run, "position int, entry int, n long, s array<long>")
    sums = [F.sum(F.col("s")[j]).alias(f"s{j}") for j in range(width)]
    return made.groupBy("position", "entry").agg(F.sum("n").alias("n"), *sums)


def _assigned(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """position, part, entry, far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1 << 16):
            entries, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for _, held, _, best, off in _nearest(batch, books):
                entries[held], far[held] = best, off
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(entries), pa.array(far)], ["position", "part", "entry", "far"])

    return distinct.select("position", "part").mapInArrow(run, "position int, part array<int>, entry int, far long")


def learn(distinct: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """The codebooks (position, entry, component) after so many rounds of weighted Lloyd."""
    for _ in range(rounds):
        books = books.copy()
        for r in _sums(distinct, books).collect():  # a row for each entry of each position
            books[r.position, r.entry] = [r[f"s{j}"] // r.n for j in range(books.shape[2])]
    return books


def _put_together(kept: DataFrame, coded: DataFrame, parts: int, label: str) -> DataFrame:
    """vec_id, label, code, error of ``kept`` (block, vec_id, label, e) from ``coded`` (block, position, part, entry, far)."""

    def run(rows: pa.Table, codes: pa.Table) -> pa.Table:
        rows, codes = rows.combine_chunks(), codes.combine_chunks()
        if not rows.num_rows:
            return pa.table({"vec_id": pa.array([], pa.int64()), "label": rows.column("label"), "code": pa.array([], pa.string()), "error": pa.array([], pa.int64())})
        flat = lambda t, c: t.column(c).combine_chunks()
        matrix, values = _matrix(flat(rows, "e")), _matrix(flat(codes, "part"))
        positions, entry, far = (flat(codes, c).to_numpy() for c in ("position", "entry", "far"))
        width = matrix.shape[1] // parts
        entries, error = np.empty((len(matrix), parts), np.uint8 if entry.max() < 256 else np.int64), np.zeros(len(matrix), np.int64)
        raw = lambda m: np.ascontiguousarray(m).view(np.dtype((np.void, m.itemsize * width))).ravel()
        for at in range(parts):
            here = np.flatnonzero(positions == at)
            known = raw(values[here])
            order = np.argsort(known)
            found = here[order[np.searchsorted(known, raw(matrix[:, at * width : (at + 1) * width]), sorter=order)]]
            entries[:, at] = entry[found]
            error += far[found]
        code = ["".join(f"{x:02x}" for x in row) for row in entries.tolist()]
        return pa.table({"vec_id": rows.column("vec_id"), "label": rows.column("label"), "code": pa.array(code, pa.string()), "error": pa.array(error)})

    return kept.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(run, RESULT.format(label=label))


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector that takes part."""
    spark = vectors.sparkSession
    common.ship_package(spark)
    rows = lattice.integers(vectors, scale, vector_column, F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.col(f"`{label_column}`").alias("label"))
    rows = common.numbered(rows, "vectors", "number")
    label = dict(rows.dtypes)["label"]
    lengths = rows.groupBy(F.size("e").alias("n")).count().where(F.col("n").between(1, 1 << 20) & (F.col("n") % parts == 0))
    length = lengths.orderBy(F.desc("count"), "n").limit(1).collect()
    if not length:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    kept = rows.where(F.size("e") == length[0].n).withColumn("block", F.shiftright("number", BATCH.bit_length() - 1))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "e").limit(entries).select("e").collect()
    books = np.array([r.e for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)

    held = common.materialise(split(kept, parts), "parts")
    distinct = common.materialise(held.groupBy("position", "part").agg(F.sum("weight").alias("weight")), "distinct")
    books = learn(distinct, books, rounds)
    coded = held.select("block", "position", "part").join(_assigned(distinct, books), ["position", "part"])
    made = common.materialise(_put_together(kept.select("block", "vec_id", "label", "e"), coded, parts, label), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long")
    by_label = made.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    made = made.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return made.select("vec_id", "code", "error", "label_error", F.lit(lattice.sha256(books.ravel().tolist())).alias("codebooks_sha256"))


def _sql(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    """The same in DuckDB, for vectors of one length."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (
  SELECT num, pos, min_by(entry, (far, entry)) AS entry, min(far) AS far FROM (
    SELECT v.num, v.pos, b.entry, sum((v.x - b.x) * (v.x - b.x))::BIGINT AS far
    FROM parts v JOIN b{n} b ON v.pos = b.pos AND v.place = b.place GROUP BY ALL)
  GROUP BY num, pos)""")
        if n < rounds:
            steps.append(f"""b{n + 1} AS MATERIALIZED (
  SELECT b.pos, b.entry, b.place, coalesce(m.x, b.x) AS x FROM b{n} b LEFT JOIN (
    SELECT v.pos, a.entry, v.place, (sum(v.x) - ((sum(v.x) % count(*)) + count(*)) % count(*))::BIGINT // count(*) AS x
    FROM parts v JOIN a{n} a ON v.num = a.num AND v.pos = a.pos GROUP BY ALL) m
  ON b.pos = m.pos AND b.entry = m.entry AND b.place = m.place)""")
    steps = ", ".join(steps)
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, [floor({scale} * x::DOUBLE)::BIGINT for x in embedding] AS e,
    row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS num
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), flat AS (
  SELECT num, len(e) // {parts} AS width, unnest(e) AS x, unnest(range(len(e))) AS i FROM kept
), parts AS MATERIALIZED (SELECT num, i // width AS pos, i % width AS place, x FROM flat),
b0 AS MATERIALIZED (SELECT pos, num AS entry, place, x FROM parts WHERE num < {entries}),
{steps}, books AS (
  SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY pos, entry, place)) AS codebooks_sha256 FROM b{rounds}
), coded AS (
  SELECT num, string_agg(printf('%02x', entry), '' ORDER BY pos) AS code, sum(far)::BIGINT AS error FROM a{rounds} GROUP BY num
)
SELECT k.vec_id, c.code, c.error, sum(c.error) OVER (PARTITION BY k.label)::BIGINT AS label_error, codebooks_sha256
FROM kept k JOIN coded c USING (num), books
"""


ORACLE_SQL = _sql()
