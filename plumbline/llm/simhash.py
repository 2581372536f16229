"""SimHash near-duplicates by a byte-position index with count filtering.

Two 64-bit fingerprints that differ in at most 4 bits share at least 4 of
their 8 positional bytes.  Posting lists of single positional bytes would be
read in pairs that grow with the square of the corpus, so the index keys on
three positional bytes at once: of the 56 triples of positions, 20 chosen ones
(three groups of positions in a ring) lie in every set of 4, so the guaranteed
matches always meet in one posting list.  Within a list the positional bytes
shared by each pair are tallied, pairs under the minimum of 4 dropped, and the
rest verified on all bits.  A list yields for each member the first one that
its links lead to, so a group of n copies costs n edges.

A list longer than ``LIST`` fingerprints is split by a fourth byte, of each of the
five positions left, which keeps every link; what four bytes leave longer still is
resolved in another exact way: fingerprints at most 4 bits apart have a value
in common within 2 bits of each, so members are linked through the values
around them.

Defined results: a null or wordless text has fingerprint zero and is linked
like any other; equal rows and exact copies share a fingerprint; component_id
is the smallest doc_id reachable, null only if all its doc_ids are; an empty
table gives no rows; columns not named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, tokenize
from .components import components

BITS, MATCHES = 4, 4
LIST = 16_384
_RING = ((0, 1, 2), (3, 4, 5), (6, 7))


def _triples() -> list[tuple[int, int, int]]:
    """Triples in one group of positions, or two of one group and one of the next.

    Any 4 positions hold such a triple (Turan's construction).
    """
    group = {p: g for g, ps in enumerate(_RING) for p in ps}
    out = []
    for t in combinations(range(8), 3):
        counts = [sum(group[p] == g for p in t) for g in range(3)]
        if 3 in counts or any(counts[g] == 2 and counts[(g + 1) % 3] == 1 for g in range(3)):
            out.append(t)
    return out


TRIPLES = _triples()


def fingerprint(text: str | None, words: int = 4) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles."""
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    starts = np.concatenate([[0], np.cumsum(lengths[:-1] + 1)])
    n = max(1, len(tokens) - words + 1)
    ends = (starts + lengths)[min(words, len(tokens)) - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends.tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and fingerprint (as a signed long) of every whole text."""
    common.ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            made = np.array([fingerprint(x, words) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _join(roots: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """``roots`` (of each member, the least known to be joined with it) once the members ``one`` and ``two`` are joined."""
    while True:
        a, b = roots[one], roots[two]
        apart = a != b
        if not apart.any():
            return roots
        np.minimum.at(roots, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (up := roots[roots]).tobytes() != roots.tobytes():
            roots = up


def link_list(values: np.ndarray, block: int = 512) -> np.ndarray:
    """For each member of a posting list, the first member that its links lead to.

    Shared positional bytes are tallied for all pairs, a block of rows at a
    time; only pairs with the minimum number are verified.
    """
    n, roots = len(values), np.arange(len(values))
    octets = np.ascontiguousarray(values.view(np.uint8).reshape(n, 8).T)
    for low in range(0, n, block):
        for col in range(0, low + 1, block):
            mine, theirs = roots[low : low + block], roots[col : col + block]
            if mine.min() == mine.max() == theirs.min() == theirs.max():
                continue  # all joined already
            tally = np.zeros((len(mine), len(theirs)), np.uint8)
            for row in octets:
                tally += row[low : low + block, None] == row[None, col : col + block]
            i, j = np.nonzero(tally >= MATCHES)
            i, j = i + low, j + col
            near = (j < i) & (np.bitwise_count(values[i] ^ values[j]) <= BITS)
            roots = _join(roots, i[near], j[near])
    return roots


def _key(triple: tuple[int, int, int], n: int):
    """Triple number and its three positional bytes, as one long."""
    parts = [F.shiftleft(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)), 8 * at) for at, p in enumerate(triple)]
    return F.lit(n << 24).cast("long") + parts[0] + parts[1] + parts[2]


def _around() -> list[int]:
    """Signed masks of at most 2 bits."""
    masks = [0, *(1 << i for i in range(64)), *((1 << i) | (1 << j) for i, j in combinations(range(64), 2))]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _resolve(posted: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) of the posting lists of (fp, key) up to LIST members; fp and key of the longer ones' members."""
    limit = LIST
    parts = posted.repartition(common.shuffle_partitions(posted.sparkSession), "key").sortWithinPartitions("key")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            roots = link_list(values.view(np.uint64))
            at = np.flatnonzero(roots != np.arange(len(roots)))
            return values[at], values[roots[at]], np.full(len(at), -1)

        tokenize.forget()
        open_key, held, count, over = None, [], 0, False
        for batch in batches:
            fps, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            made = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if keys[a] != open_key:
                    if count > 1 and not over:
                        made.append(flush(np.concatenate(held)))
                    open_key, held, count, over = keys[a], [], 0, False
                held.append(fps[a:b])
                count += b - a
                if over or count > limit:
                    values = np.concatenate(held)
                    made.append((values, values, np.full(len(values), open_key)))
                    held, over = [], True
            yield from _edges(made)
        if count > 1 and not over:
            yield from _edges([flush(np.concatenate(held))])

    found = common.materialise(parts.select("fp", "key").mapInArrow(resolve, "a long, b long, long_list long"), tag)
    return found.where("long_list < 0").select("a", "b"), found.where("long_list >= 0").select(F.col("a").alias("fp"), F.col("long_list").alias("key"))


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between fingerprints whose components are those of all links.

    ``distinct`` holds every fingerprint once, as ``fp``.
    """
    common.ship_package(distinct.sparkSession)
    posted = distinct.select("fp", F.explode(F.array(*(_key(t, n) for n, t in enumerate(TRIPLES)))).alias("key"))
    short, rest = _resolve(posted, "links")
    # Members of a long list have three bytes in common; those that are linked share a fourth.
    octet = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
    triple = F.shiftrightunsigned("key", 24)
    outside = F.element_at(F.array(*(F.array(*(F.struct(F.lit(p).alias("at"), octet(p).alias("byte")) for p in range(8) if p not in t)) for t in TRIPLES)), (triple + 1).cast("int"))
    fourth = rest.select("fp", "key", F.explode(outside).alias("x"))
    fourth = fourth.select("fp", (F.shiftleft("key", 11) + F.shiftleft(F.col("x.at").cast("long"), 8) + F.col("x.byte")).alias("key"))
    split, rest = _resolve(fourth, "fourth")
    # What even four bytes do not part is linked through the values within 2 bits of each member.
    hot = rest.select(F.col("fp").alias("a")).distinct()
    near = hot.select("a", F.explode(F.transform(F.lit(_around()), lambda m: F.col("a").bitwiseXOR(m))).alias("value"))
    hubs = near.groupBy("value").agg(F.min("a").alias("b"))
    through = near.join(hubs, "value").where("a <> b").select("a", "b")
    return short.union(split).union(through).distinct()


def _edges(made: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    if made:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*made, strict=True)], ["a", "b", "long_list"])


def near_duplicates(docs: DataFrame, words: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, fp and component_id of every row of ``docs``."""
    rows = common.materialise(fingerprints(docs, words, id_column, text_column), "fingerprints")
    whole = _grouped(rows)
    ids = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    named = whole.join(ids, "component").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def _grouped(rows: DataFrame) -> DataFrame:
    """fp, least (doc_id) and component (a fingerprint) of each distinct fingerprint."""
    classes = common.materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    joined = components(links(classes.select("fp")))
    return classes.join(joined, classes.fp == joined.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))


def keep_one(docs: DataFrame, words: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each group of near copies, all columns: the least doc_id's, of its least fingerprint.

    Of rows equal in both, the first in the files stays.
    """
    common.ship_package(docs.sparkSession)
    at, p = docs.columns.index(text_column), common.private(*docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            made = np.array([fingerprint(x, words) for x in batch.column(at).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made.view(np.int64))], [*batch.schema.names, "m0"])

    marked = common.numbered(common.map_rows(docs, run, T.StructField(f"{p}fp", T.LongType())), "marked", f"{p}row")
    name = common.column(id_column).cast("long")
    whole = _grouped(marked.select(name.alias("doc_id"), F.col(f"{p}fp").alias("fp")))
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "fp")).alias("first")
    kept = whole.groupBy("component").agg(first).select(F.col("first.least").alias(f"{p}least"), F.col("first.fp").alias(f"{p}kept"))
    only = common.occurrences(marked, [id_column, f"{p}fp"], f"{p}row", f"{p}copy").where(F.col(f"{p}copy") == 0)
    found = only.join(kept, (F.col(f"{p}fp") == F.col(f"{p}kept")) & name.eqNullSafe(F.col(f"{p}least")))
    return found.select(*map(common.column, docs.columns))
