"""Best-fit packing by a grouping genetic algorithm.

Pieces of one length are interchangeable, so the search works on how many
pieces each length has: a table of at most ``capacity`` rows, whatever the
corpus.  Counts are split into levels: at level M a *pattern* (a packing of a
bounded number of lengths) is used M times, and what a level does not place in
well-filled bins goes down to the next, as far as that stays within the bound
(beyond it the fullest other bins are used too); at level 1 everything left is packed.
Patterns are searched by islands, one Spark task each: crossover injects whole
well-filled bins of one parent, keeps the other parent's bins that need no
piece twice, and best-fits the displaced pieces; after each epoch the elites
migrate to the next island of a ring.  Each piece then finds its bin from its
length and its rank among the pieces of that length.

Defined results: a null text is empty (one piece holding the end id); a
document is cut only if longer than the capacity; repeated rows are packed each
for itself; an empty table gives no rows; columns not named are not read.
"""

from __future__ import annotations

import random
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .tokenize import encoder

#: Pieces that a pattern may hold (see ``most_pieces``); bounds every search and what is sent to the executors.
PATTERN_PIECES = 32_768
RATIO = 8
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 4, 4, 40, 8
#: Pieces that an island's children place in an epoch, about: fewer children of larger patterns, five at least.
PLACED = 100_000
WELL_FILLED = 0.99

Bin = tuple[int, ...]


# ---- the search, on plain lists of lengths -------------------------------------------------


class _Open:
    """Bins by free space; finds the fullest that still takes a piece."""

    def __init__(self, capacity: int):
        self.free: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
        self.mask, self.capacity = 0, capacity

    def add(self, items: list[int], free: int) -> None:
        self.free[free].append(items)
        self.mask |= 1 << free

    def place(self, piece: int) -> None:
        fits = self.mask >> piece
        if not fits:
            self.add([piece], self.capacity - piece)
            return
        at = piece + (fits & -fits).bit_length() - 1
        items = self.free[at].pop()
        if not self.free[at]:
            self.mask &= ~(1 << at)
        items.append(piece)
        self.add(items, at - piece)

    def bins(self) -> list[Bin]:
        return [tuple(x) for at in self.free for x in at]


def best_fit(pieces: list[int], capacity: int, onto: list[Bin] = ()) -> list[Bin]:
    space = _Open(capacity)
    for items in onto:
        space.add(list(items), capacity - sum(items))
    for piece in pieces:
        space.place(piece)
    return space.bins()


def fitness(bins: list[Bin], capacity: int) -> tuple[int, float]:
    """Fewer bins are better; among equals, more uneven fills."""
    return -len(bins), sum((sum(x) / capacity) ** 2 for x in bins)


def crossover(giver: list[Bin], taker: list[Bin], total: Counter, capacity: int, rng: random.Random) -> list[Bin]:
    full = sorted(giver, key=sum, reverse=True)[: max(1, len(giver) // 2)]
    injected = rng.sample(full, max(1, len(full) // 2))
    left = Counter(total)
    for items in injected:
        left.subtract(items)
    kept = []
    for items in sorted(taker, key=sum, reverse=True):
        need = Counter(items)
        if all(left[x] >= n for x, n in need.items()):
            left.subtract(need)
            kept.append(items)
    displaced = sorted(left.elements(), reverse=True)
    return best_fit(displaced, capacity, injected + kept)


def mutate(bins: list[Bin], capacity: int, rng: random.Random) -> list[Bin]:
    """Dissolve the emptiest bins and a few others, and place their pieces anew."""
    order = sorted(bins, key=sum)
    gone = max(1, len(order) // 50)
    loose, rest = order[:gone], order[gone:]
    for _ in range(min(gone, len(rest))):
        loose.append(rest.pop(rng.randrange(len(rest))))
    return best_fit(sorted((x for y in loose for x in y), reverse=True), capacity, rest)


def least_bins(total: Counter, capacity: int) -> int:
    """A number of bins that no packing goes below (Martello and Toth's second bound).

    For each length up to half the capacity: pieces that leave no room for it
    need a bin each, those over half too, and what pieces between it and half
    the capacity do not find room for beside the latter fills further bins.
    """
    lengths = np.array(sorted(total))
    if not len(lengths):
        return 0
    counts = np.array([total[x] for x in lengths.tolist()])
    upto = lambda x: np.searchsorted(lengths, x, side="right")
    number, mass = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])
    half, best = upto(capacity // 2), -(-int(mass[-1]) // capacity)
    for at in range(half):
        wide = upto(capacity - int(lengths[at]))
        beside = number[wide] - number[half]
        room = beside * capacity - (mass[wide] - mass[half])
        best = max(best, int(number[-1] - number[half] + max(0, -(-(mass[half] - mass[at] - room) // capacity))))
    return max(best, int(number[-1] - number[half]))


def evolve(total: Counter, capacity: int, seeds: list[list[Bin]], rng: random.Random) -> list[Bin]:
    least = least_bins(total, capacity)
    pieces = sorted(total.elements(), reverse=True)
    population = [*seeds, best_fit(pieces, capacity)]
    best = max(population, key=lambda x: fitness(x, capacity))
    children = max(5, min(GENERATIONS, PLACED // max(1, len(pieces))))
    while len(best) > least and len(population) < min(POPULATION, children):
        bent = sorted(pieces, key=lambda x: -x * rng.uniform(0.7, 1))
        population.append(best_fit(bent, capacity))
    for _ in range(children):
        best = max(population, key=lambda x: fitness(x, capacity))
        if len(best) <= least:
            break
        one, two = (max(rng.sample(population, 2), key=lambda x: fitness(x, capacity)) for _ in range(2))
        child = mutate(crossover(one, two, total, capacity, rng), capacity, rng)
        population[population.index(min(population, key=lambda x: fitness(x, capacity)))] = child
    return max(population, key=lambda x: fitness(x, capacity))


def _pack(bins: list[Bin]) -> bytes:
    return np.array([y for x in bins for y in (len(x), *x)], "<u4").tobytes()


def _unpack(raw: bytes) -> list[Bin]:
    flat, at, out = np.frombuffer(raw, "<u4").tolist(), 0, []
    while at < len(flat):
        out.append(tuple(flat[at + 1 : at + 1 + flat[at]]))
        at += 1 + flat[at]
    return out


def islands(spark: SparkSession, total: Counter, capacity: int, seed: int) -> list[Bin]:
    """The best packing that a ring of islands finds for one bounded pattern.

    The search ends where no packing can be better, or after EPOCHS, or two epochs in a row without a better one.
    """
    least = least_bins(total, capacity)
    first = best_fit(sorted(total.elements(), reverse=True), capacity)
    if len(first) <= least:
        return first
    common.ship_package(spark)
    elites, best, idle = [_pack(first)] * ISLANDS, fitness(first, capacity), 0

    def grow(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            for row in batch.to_pylist():
                rng = random.Random(f"{seed}/{row['epoch']}/{row['island']}")
                bins = evolve(total, capacity, [_unpack(x) for x in row["elites"]], rng)
                yield pa.RecordBatch.from_pydict({"island": pa.array([row["island"]], pa.int32()), "bins": pa.array([_pack(bins)], pa.binary())})

    for epoch in range(EPOCHS):
        rows = [(n, epoch, [elites[n], elites[n - 1]]) for n in range(ISLANDS)]
        frame = spark.createDataFrame(rows, "island int, epoch int, elites array<binary>").repartitionByRange(ISLANDS, "island")
        elites = [bytes(r.bins) for r in sorted(frame.mapInArrow(grow, "island int, bins binary").collect())]
        now = max(fitness(_unpack(x), capacity) for x in elites)
        best, idle = (now, 0) if now > best else (best, idle + 1)
        if -best[0] <= least or idle == 2:
            break
    return max((_unpack(x) for x in elites), key=lambda x: fitness(x, capacity))


def most_pieces(capacity: int) -> int:
    """What a pattern holds at most: fewer than RATIO of each length are left where every bin is used."""
    return max(PATTERN_PIECES, (RATIO - 1) * (capacity - 1))


def used_bins(bins: list[Bin], left: dict[int, int], capacity: int, times: int) -> list[Bin]:
    """The bins used at a level above 1: the well-filled ones, and the fullest others while the next pattern would hold too many pieces."""
    used, lower = set(), sum(n // (times // RATIO) for n in left.values())
    for n in sorted(range(len(bins)), key=lambda n: -sum(bins[n])):
        if sum(bins[n]) < WELL_FILLED * capacity and lower <= most_pieces(capacity):
            break
        used.add(n)
        lower -= RATIO * len(bins[n])
    return [x for n, x in enumerate(bins) if n in used]


def plan(spark: SparkSession, counts: dict[int, int], capacity: int, seed: int = 7) -> list[tuple]:
    """Rows (length, level rows) from piece counts; see ``assign``.

    A level row is (first rank, pieces in the pattern, times, first sequence,
    bins in the pattern, [(bin, offset) of each piece]).
    """
    left, levels, sequence = Counter({k: n for k, n in counts.items() if n and k < capacity}), {k: [] for k in counts}, 0
    if whole := counts.get(capacity):
        levels[capacity].append((0, 1, whole, 0, 1, [(0, 0)]))
        sequence = whole
    used: Counter = Counter()
    times = 1
    while sum(n // times for n in left.values()) > PATTERN_PIECES:
        times *= RATIO
    while left:
        total = Counter({k: n // times for k, n in left.items() if n >= times})
        if total.total() > most_pieces(capacity):
            raise AssertionError(f"a pattern of {total.total()} pieces")
        bins = islands(spark, total, capacity, seed + times) if total else []
        if times > 1:
            bins = used_bins(bins, left, capacity, times)
        slots: dict[int, list[tuple[int, int]]] = {}
        for n, items in enumerate(bins):
            at = 0
            for piece in items:
                slots.setdefault(piece, []).append((n, at))
                at += piece
        for length, places in slots.items():
            levels[length].append((used[length], len(places), times, sequence, len(bins), places))
            used[length] += times * len(places)
            left[length] -= times * len(places)
        left = +left
        sequence += times * len(bins)
        if times == 1:
            break
        times //= RATIO
    return list(levels.items())


# ---- the corpus ----------------------------------------------------------------------------


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, *, spaces_dropped: bool = True, with_ids: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Token pieces of whole texts: doc_id, piece, start, length, ids_crc32 and, if asked, ids."""
    common.ship_package(docs.sparkSession)
    name = common.ship_file(docs.sparkSession, tokenizer)
    kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.list_(pa.int64())} if with_ids else {})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, end = encoder(common.shipped(name), spaces_dropped), np.array([end_id], "<u4").tobytes()
        for batch in common.slices(batches, tokens=True):
            out = {k: [] for k in kinds}
            for doc_id, raw in zip(batch.column(0).to_pylist(), codec.encode(batch.column(1).to_pylist()), strict=True):
                raw += end
                for n, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    row = (doc_id, n, at // 4, len(part) // 4, zlib.crc32(part))
                    for key, value in zip(kinds, row, strict=False):
                        out[key].append(value)
                    if with_ids:
                        out["ids"].append(np.frombuffer(part, "<u4").astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in kinds.items()], list(kinds))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")).mapInArrow(cut, schema)


def _level(field: str) -> Column:
    return F.col("found")[field]


def pack(rows: DataFrame, capacity: int) -> DataFrame:
    """``rows`` (with ``length`` 1 to capacity, and doc_id, piece) with sequence_id and offset.

    Of the corpus, the driver sees one count per length.  A hot length is
    ranked in as many tasks as its count needs, equal rows or not.
    """
    spark, p, columns = rows.sparkSession, common.private(*rows.columns), [F.col(f"`{c}`") for c in rows.columns]
    rows = common.numbered(rows, "pieces", f"{p}row")
    counts = {r.length: r["count"] for r in rows.groupBy("length").count().collect()}
    schema = "length long, buckets int, levels array<struct<first: long, n: long, times: long, sequence: long, bins: long, slots: array<struct<bin: long, at: long>>>>"
    table = spark.createDataFrame([(k, -(-counts[k] // common.TASK_ROWS), v) for k, v in plan(spark, counts, capacity)], schema)
    table = F.broadcast(table)  # a row for each length and at most most_pieces(capacity) slots a level
    salted = rows.join(table.select("length", "buckets"), "length").withColumn("bucket", F.pmod(F.xxhash64(f"{p}row"), F.col("buckets")))
    sizes = salted.groupBy("length", "bucket").agg(F.count("*").alias("held"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("length", "bucket").orderBy(f"{p}row")
    ranked = salted.withColumn("place", F.row_number().over(within) - 1).join(sizes, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("place") + F.col("ahead"))
    found = ranked.join(table.select("length", "levels"), "length").withColumn(
        "found", F.filter("levels", lambda x: (F.col("rank") >= x["first"]) & (F.col("rank") < x["first"] + x["n"] * x["times"]))[0]
    )
    turn = F.col("rank") - _level("first")
    slot = F.col("found.slots")[(turn % _level("n")).cast("int")]
    found = found.withColumn("slot", slot).withColumn("copy", F.floor(turn / _level("n")))
    return found.select(*columns, (_level("sequence") + F.col("copy") * _level("bins") + F.col("slot.bin")).alias("sequence_id"), F.col("slot.at").alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """Token ids of each sequence; ``packed`` needs ``ids``. A sequence holds ``capacity`` ids at most."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, **options) -> DataFrame:
    return pack(pieces(docs, tokenizer, capacity, end_id, **options), capacity)
