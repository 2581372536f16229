"""Near-duplicate vectors by a robust-pruned flat graph built on overlapping shards.

Equal vectors are one node with a weight.  Nodes are dealt into overlapping cells:
a cell over ``CELL`` nodes draws leaders from a bounded sample, none within
twice the link angle of another, and each node goes to the ``OVERLAP`` nearest,
again and again while cells are large and divide.  Leaders that far apart cannot
part a group whose members all link with one of them.  A cell that does not
divide, such as a large group of near copies, is held in blocks, which meet in
pairs, a task for each.

In each cell (block) a flat graph is built: greedy searches from the medoid give
every node candidates, robust pruning keeps those that no kept one covers.  The
adjacency lists that a node gets in its cells are united.  Then every node is searched
for in every cell that holds it: greedily from the medoid, and from there (and from its
own place) through all nodes in range as long as their neighbours bring new
ones.  A link counts only if its cosine in double precision reaches the threshold.  A pair
that several cells hold belongs to the first of them, so counts are made where
pairs are found: a task gives one row for each node, its links and the least node
it hangs together with, never its pairs.

An audit compares a bounded sample of nodes with all others; while its recall
is under ``RECALL`` the search is done again with a beam of twice the width, ``TRIES``
times at most.

Defined results: vectors that are null, zero, empty or hold null or non-finite
components, and rows of null id, link with nothing (component null for a null id);
vectors link only with those of their length; equal rows are vectors of their own
that link with each other; an empty table gives no rows; other columns are not
read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, components
from .neighbours import _unit, finite

CELL, OVERLAP, SAMPLE, LEADERS, DIVIDES = 4096, 2, 1024, 128, 0.75
DEGREE, BEAM, ALPHA, EXPAND, AT_ONCE, SEED = 24, 24, 1.2, 4, 512, 12
AUDIT, RECALL, TRIES = 1024, 0.97, 3


class Graph:
    """A flat graph over unit vectors; ``links`` holds places, -1 where a list ends."""

    def __init__(self, vectors: np.ndarray, links: np.ndarray | None = None):
        self.vectors, self.small = vectors, vectors.astype(np.float32)
        self.medoid = int((vectors @ vectors.mean(axis=0)).argmax())
        if links is None:
            self._build()
        else:
            self.links = links

    def _build(self) -> None:
        n, rng = len(self.vectors), np.random.default_rng(SEED)
        self.links = np.full((n, DEGREE), -1, np.int64)
        if n < 2:
            return
        start = rng.integers(0, n - 1, (n, min(DEGREE // 2, n - 1)))
        self.links[:, : start.shape[1]] = start + (start >= np.arange(n)[:, None])  # never itself
        order = rng.permutation(n)
        for at in range(0, n, AT_ONCE):
            some = order[at : at + AT_ONCE]
            ids, _ = self.walk(self.small[some], BEAM)
            self.links[some] = self._prune(some, np.column_stack([ids, self.links[some]]))
            self._back(some)

    def _back(self, some: np.ndarray) -> None:
        """Have the neighbours of ``some`` know them too; lists that grow too long are pruned."""
        source, target = np.repeat(some, DEGREE), self.links[some].ravel()
        source, target = source[target >= 0], target[target >= 0]
        nearness = np.einsum("ij,ij->i", self.small[source], self.small[target])
        order = np.lexsort((-nearness, target))
        source, target = source[order], target[order]
        first = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
        rank = np.arange(len(target)) - np.repeat(first, np.diff(np.r_[first, len(target)]))
        near = rank < DEGREE
        wanted = target[first]
        new = np.full((len(wanted), DEGREE), -1, np.int64)
        new[np.searchsorted(wanted, target[near]), rank[near]] = source[near]
        for at in range(0, len(wanted), AT_ONCE):
            part = wanted[at : at + AT_ONCE]
            self.links[part] = self._prune(part, np.column_stack([self.links[part], new[at : at + AT_ONCE]]))

    def _prune(self, nodes: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Of each node's candidates the nearest, leaving out whom a kept one covers."""
        order = np.sort(candidates, axis=1)
        order[:, 1:][order[:, 1:] == order[:, :-1]] = -1
        order[order == nodes[:, None]] = -1
        held = self.small[order]
        far = 2 - 2 * np.einsum("bcd,bd->bc", held, self.small[nodes])
        far[order < 0] = np.inf
        between = 2 - 2 * np.matmul(held, held.transpose(0, 2, 1))
        kept, rows = np.full((len(nodes), DEGREE), -1, np.int64), np.arange(len(nodes))
        for turn in range(DEGREE):
            best = far.argmin(axis=1)
            there = np.isfinite(far[rows, best])
            if not there.any():
                break
            kept[there, turn] = order[rows, best][there]
            covered = ALPHA * ALPHA * np.maximum(between[rows, best], 0) <= far
            far[covered & there[:, None]] = np.inf
            far[rows, best] = np.inf
        return kept

    def walk(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Greedy search from the medoid for each query: the best places met (-1 where fewer) and all places seen."""
        n, q = len(self.small), len(queries)
        seen = np.zeros((q, n), bool)
        seen[:, self.medoid] = True
        ids, score, open_ = np.full((q, beam), -1, np.int64), np.full((q, beam), -np.inf, np.float32), np.zeros((q, beam), bool)
        ids[:, 0], score[:, 0], open_[:, 0] = self.medoid, queries @ self.small[self.medoid], True
        while len(rows := np.flatnonzero(open_.any(axis=1))):
            waiting = np.where(open_[rows], score[rows], -np.inf)
            at = np.argpartition(-waiting, min(EXPAND, beam) - 1, axis=1)[:, :EXPAND]
            usable = np.isfinite(np.take_along_axis(waiting, at, axis=1))
            open_[rows[:, None], at] = False
            near = self.links[np.take_along_axis(ids[rows], at, axis=1)]
            near[~usable] = -1
            near = near.reshape(len(rows), -1)
            who, place = np.nonzero((near >= 0) & ~seen[rows[:, None], near])
            name = np.unique(rows[who] * n + near[who, place])  # once, though two lists may hold it
            who, near = np.divmod(name, n)
            seen[who, near] = True
            first = np.searchsorted(who, rows)
            count = np.searchsorted(who, rows, side="right") - first
            width = int(count.max(initial=0))
            if not width:
                continue
            column = np.arange(len(who)) - np.repeat(first, count)
            row = np.repeat(np.arange(len(rows)), count)
            more, value = np.full((len(rows), width), -1, np.int64), np.full((len(rows), width), -np.inf, np.float32)
            more[row, column], value[row, column] = near, np.einsum("ij,ij->i", self.small[near], queries[who])
            names, values = np.column_stack([ids[rows], more]), np.column_stack([score[rows], value])
            still = np.column_stack([open_[rows], more >= 0])
            best = np.argpartition(-values, beam - 1, axis=1)[:, :beam]
            ids[rows], score[rows], open_[rows] = (np.take_along_axis(x, best, axis=1) for x in (names, values, still))
        return ids, seen

    def reach(self, queries: np.ndarray, own: np.ndarray | None, least: float, beam: int) -> Iterator[tuple[int, np.ndarray]]:
        """(first query, hits): which places reach the cosine ``least``, for some queries at a time; ``own`` are the queries' places."""
        for at in range(0, len(queries), AT_ONCE):
            asked = queries[at : at + AT_ONCE]
            ids, _ = self.walk(asked.astype(np.float32), beam)
            hits, seen = np.zeros((len(asked), len(self.vectors)), bool), np.zeros((len(asked), len(self.vectors)), bool)
            who, place = np.nonzero(ids >= 0)
            near = ids[who, place]
            if own is not None:
                who, near = np.r_[who, np.arange(len(asked))], np.r_[near, own[at : at + AT_ONCE]]
            while len(who):
                name = np.unique(who * len(self.vectors) + near)
                who, near = np.divmod(name, len(self.vectors))
                seen[who, near] = True
                found = [self._verified(asked, who[x : x + 65_536], near[x : x + 65_536], least) for x in range(0, len(who), 65_536)]
                found = np.concatenate(found)
                who, near = who[found], near[found]
                hits[who, near] = True
                reached = []
                for x in range(0, len(who), 65_536):  # the neighbours of what is in range
                    lists = self.links[near[x : x + 65_536]]
                    rows = np.broadcast_to(who[x : x + 65_536, None], lists.shape)
                    new = (lists >= 0) & ~seen[rows, lists]
                    seen[rows[new], lists[new]] = True
                    reached.append(np.unique(rows[new] * len(self.vectors) + lists[new]))
                who, near = np.divmod(np.concatenate(reached) if reached else np.empty(0, np.int64), len(self.vectors))
            yield at, hits

    def _verified(self, queries: np.ndarray, who: np.ndarray, near: np.ndarray, least: float) -> np.ndarray:
        return np.einsum("ij,ij->i", queries[who], self.vectors[near]) >= least


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    return lists.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1).astype(np.float64)


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*rows, np.empty(0)]).astype(kind.to_pandas_dtype()), kind))


def _leaders(least: float):
    """Of a cell's sample, in the order of their numbers, those that are twice the link angle apart."""
    apart = 2 * least * least - 1  # cosine of twice the angle

    def run(rows: pa.Table) -> pa.Table:
        vectors = _unit(_matrix(rows.column("e")))[np.argsort(rows.column("number").to_numpy(), kind="stable")]
        wanted = min(LEADERS, max(2, -(-3 * rows.column("n")[0].as_py() // CELL)))
        held, near = [], np.full(len(vectors), -np.inf)
        while len(held) < wanted and (near < apart).any():
            held.append(vectors[int((near < apart).argmax())])
            near = np.maximum(near, vectors @ held[-1])
        return pa.table({"cell": rows.column("cell")[:1], "k": pa.array([len(held)], pa.int32()), "leaders": _lists([np.concatenate(held)], pa.float64())})

    return run


def _deal(kind: pa.DataType):
    def run(rows: pa.Table, there: pa.Table) -> pa.Table:
        names = ["cell", "number", "e", "up"]
        if not rows.num_rows or not there.num_rows:
            return pa.table({"cell": pa.array([], pa.string()), "number": pa.array([], pa.int64()), "e": pa.array([], kind), "up": pa.array([], pa.int64())})
        leaders = _matrix(there.column("leaders")).reshape(there.column("k")[0].as_py(), -1)
        near = _unit(_matrix(rows.column("e"))) @ leaders.T
        to = np.argsort(-near, axis=1, kind="stable")[:, :OVERLAP]
        at = np.repeat(np.arange(rows.num_rows), to.shape[1])
        begin = rows.column("cell")[0].as_py()
        taken = rows.select(["number", "e", "n"]).take(pa.array(at))
        return pa.table([pa.array([f"{begin}/{j}" for j in to.ravel()]), *taken.columns], names)

    return run


def _cells(nodes: DataFrame, least: float) -> DataFrame:
    """cell, number, e, n (nodes of the cell): nodes in overlapping cells."""
    kind = dict(nodes.dtypes)["e"]
    arrow = pa.list_(pa.float64() if "double" in kind else pa.float32())
    held = nodes.select(F.size("e").cast("string").alias("cell"), "number", "e", F.lit(None).cast("long").alias("up"))
    done: DataFrame | None = None
    while True:
        counts = held.groupBy("cell").agg(F.count("*").alias("n"), F.first("up").alias("was"))
        counts = common.materialise(counts, "cells")
        divides = (F.col("n") > CELL) & (F.col("was").isNull() | (F.col("n") <= DIVIDES * F.col("was")))
        large = counts.where(divides).select("cell", "n")
        rows = held.join(large, "cell")
        picked = rows.where(F.pmod(F.xxhash64(F.lit("leader"), "number"), F.ceil(F.col("n") / SAMPLE)) == 0)
        leaders = picked.select("cell", "number", "e", "n").groupBy("cell").applyInArrow(_leaders(least), "cell string, k int, leaders array<double>")
        leaders = common.materialise(leaders.where("k > 1").join(large, "cell"), "leaders")
        whole = held.join(counts, "cell").join(leaders.select("cell"), "cell", "left_anti").select("cell", "number", "e", "n")
        done = whole if done is None else done.unionByName(whole)
        if leaders.isEmpty():
            return common.materialise(done, "dealt")
        salts = F.ceil(F.col("n") / CELL)
        asked = held.join(leaders.select("cell", "n"), "cell").select("cell", F.pmod(F.xxhash64("number"), salts).alias("salt"), "number", "e", "n")
        there = leaders.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), "k", "leaders")
        held = asked.groupBy("cell", "salt").cogroup(there.groupBy("cell", "salt")).applyInArrow(_deal(arrow), f"cell string, number long, e {kind}, up long")
        held = common.materialise(held, "dealt")


def _build(rows: pa.Table) -> pa.Table:
    numbers = rows.column("number").to_numpy()
    links = Graph(_unit(_matrix(rows.column("e")))).links
    return pa.table({"number": rows.column("number"), "near": _lists([numbers[x[x >= 0]] for x in links], pa.int64())})


def _places(numbers: np.ndarray, lists: pa.ChunkedArray) -> np.ndarray:
    """Adjacency lists of numbers as places among ``numbers``, those that are elsewhere left out."""
    lists = lists.combine_chunks()
    flat, length = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
    order = np.argsort(numbers)
    at = np.minimum(np.searchsorted(numbers, flat, sorter=order), len(numbers) - 1)
    place = np.where(numbers[order[at]] == flat, order[at], -1)
    out = np.full((len(numbers), max(1, int(length.max(initial=0)))), -1, np.int64)
    out[np.repeat(np.arange(len(numbers)), length), np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = place
    return out


def _search(least: float, beam: int):
    """number, links, root of the nodes of one pair of blocks (or of one) of a cell."""

    def run(rows: pa.Table) -> pa.Table:
        cell, blocks, numbers = rows.column("cell")[0].as_py(), rows.column("block").to_numpy(), rows.column("number").to_numpy()
        cells = rows.column("cells").to_pylist()
        earlier = {c: j for j, c in enumerate(sorted({c for x in cells for c in x if c < cell}))}
        weight = rows.column("weight").to_numpy()
        sides = []
        for block in np.unique(blocks):
            at = np.flatnonzero(blocks == block)
            part = rows.take(pa.array(at))
            vectors = _unit(_matrix(part.column("e")))
            sides.append((at, vectors, Graph(vectors, _places(numbers[at], part.column("near")))))
        if len(sides) < 2 and rows.column("lo")[0].as_py() != rows.column("hi")[0].as_py():
            return _nothing()
        (a, left, there), (b, right, here) = sides[0], sides[-1]
        alone = len(sides) == 1
        met = np.zeros((len(a), len(b)), bool)
        for at, hits in here.reach(left, np.arange(len(a)) if alone else None, least, beam):
            met[at : at + len(hits)] = hits
        if alone:
            met |= met.T.copy()
            np.fill_diagonal(met, False)
        else:
            for at, hits in there.reach(right, None, least, beam):
                met[:, at : at + len(hits)] |= hits.T
        before = np.zeros((len(numbers), len(earlier)), bool)
        for place, x in enumerate(cells):
            before[place, [earlier[c] for c in x if c in earlier]] = True
        for at in range(0, len(a), AT_ONCE):  # a pair that an earlier cell holds too belongs there
            met[at : at + AT_ONCE] &= ~(before[a[at : at + AT_ONCE]].astype(np.float32) @ before[b].T.astype(np.float32) > 0)
        links = np.zeros(len(numbers), np.int64)
        for at in range(0, len(a), AT_ONCE):
            links[a[at : at + AT_ONCE]] += met[at : at + AT_ONCE] @ weight[b]
        if not alone:
            for at in range(0, len(b), AT_ONCE):
                links[b[at : at + AT_ONCE]] += met[:, at : at + AT_ONCE].T @ weight[a]
        root = _roots(numbers, a, b, met)
        some = links > 0
        return pa.table({"number": pa.array(numbers[some]), "links": pa.array(links[some]), "root": pa.array(root[some])})

    return run


def _nothing() -> pa.Table:
    return pa.table({c: pa.array([], pa.int64()) for c in ("number", "links", "root")})


def _roots(numbers: np.ndarray, a: np.ndarray, b: np.ndarray, met: np.ndarray) -> np.ndarray:
    """The least number that each node hangs together with by ``met``."""
    root, far = numbers.copy(), np.iinfo(np.int64).max
    some, other = np.flatnonzero(met.any(axis=1)), np.flatnonzero(met.any(axis=0))
    met, a, b = met[np.ix_(some, other)], a[some], b[other]
    while len(some):
        was = root.copy()
        for at in range(0, len(a), AT_ONCE):
            part = met[at : at + AT_ONCE]
            root[a[at : at + AT_ONCE]] = np.minimum(root[a[at : at + AT_ONCE]], np.where(part, root[b], far).min(axis=1))
        for at in range(0, len(b), AT_ONCE):
            part = met[:, at : at + AT_ONCE].T
            root[b[at : at + AT_ONCE]] = np.minimum(root[b[at : at + AT_ONCE]], np.where(part, root[a], far).min(axis=1))
        if (root == was).all():
            break
    return root


def _audit(nodes: DataFrame, least: float) -> DataFrame:
    """number, links of a bounded sample of nodes, compared with all."""
    total = nodes.count()
    share = max(1, total // AUDIT)
    asked = nodes.where(F.pmod(F.xxhash64(F.lit("audit"), "number"), F.lit(share)) == 0).select("number", "e").collect()  # about AUDIT rows
    by: dict[int, list] = {}
    for r in asked:
        by.setdefault(len(r.e), []).append((r.number, r.e))
    sides = {n: (np.array([x[0] for x in rows]), _unit(np.array([x[1] for x in rows], np.float64))) for n, rows in by.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {n: np.zeros(len(names), np.int64) for n, (names, _) in sides.items()}
        for batch in common.slices(batches, 4096):
            lengths = batch.column(1).value_lengths().to_numpy()
            for n in np.unique(lengths).tolist():
                if n not in sides:
                    continue
                part = batch.filter(pa.array(lengths == n))
                near = _unit(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1).astype(np.float64)) @ sides[n][1].T >= least
                near &= part.column(0).to_numpy()[:, None] != sides[n][0]
                found[n] += part.column(2).to_numpy() @ near
        for n, (names, _) in sides.items():
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(found[n])], ["number", "wanted"])

    return nodes.select("number", "e", "weight").mapInArrow(run, "number long, wanted long").groupBy("number").agg(F.sum("wanted").alias("wanted"))


def near_duplicates(vectors: DataFrame, least: float = 0.95, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row, and the audited recall."""
    spark = vectors.sparkSession
    common.ship_package(spark)
    tasks = 4 * common.shuffle_partitions(spark)
    rows = vectors.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.col(f"`{vector_column}`").alias("e"))
    if dict(rows.dtypes)["e"] not in ("array<float>", "array<double>"):
        rows = rows.withColumn("e", F.transform("e", lambda x: x.cast("double")))
    rows = common.numbered(rows, "vectors", "number")
    usable = F.col("vec_id").isNotNull() & finite("e") & F.exists("e", lambda x: x != 0)
    held = rows.where(usable)
    nodes = held.groupBy("e").agg(F.min("number").alias("number"), F.count("*").alias("weight"))
    nodes = common.materialise(nodes, "nodes")

    dealt = _cells(nodes, least)
    blocks = F.ceil(F.col("n") / CELL)
    dealt = dealt.select("cell", "number", "e", blocks.alias("blocks"), F.pmod(F.xxhash64(F.lit("block"), "number"), blocks).alias("block"))
    lists = dealt.select("cell", "block", "number", "e").repartition(tasks, "cell", "block").groupBy("cell", "block").applyInArrow(_build, "number long, near array<long>")
    lists = common.materialise(lists, "lists")
    united = lists.groupBy("number").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # at most DEGREE a cell
    united = united.join(dealt.groupBy("number").agg(F.sort_array(F.collect_set("cell")).alias("cells")), "number").join(nodes.select("number", "weight"), "number")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    placed = dealt.join(united, "number").select("*", other.alias("other"))
    placed = placed.select("cell", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "number", "e", "weight", "near", "cells")
    placed = common.materialise(placed, "placed")

    wanted = common.materialise(_audit(nodes, least), "audit")
    beam = BEAM
    for turn in range(TRIES):
        dealt_out = placed.repartition(tasks, "cell", "lo", "hi").groupBy("cell", "lo", "hi")
        found = common.materialise(dealt_out.applyInArrow(_search(least, beam), "number long, links long, root long"), "found")
        links = found.groupBy("number").agg(F.sum("links").alias("links"))
        seen = wanted.join(links, "number", "left").agg(F.sum("wanted").alias("all"), F.sum("links").alias("met")).first()
        recall = (seen.met or 0) / seen["all"] if seen["all"] else 1.0
        if recall >= RECALL:
            break
        beam *= 2

    hang = components.components(found.select(F.col("number").alias("a"), F.col("root").alias("b")))
    copies = held.join(nodes.where("weight > 1").select(F.col("e").alias("same"), F.col("number").alias("node")), F.col("e") == F.col("same"), "left")
    named = copies.select("vec_id", "number", F.coalesce("node", "number").alias("node"))
    named = named.join(hang.withColumnRenamed("node", "part"), F.col("node") == F.col("part"), "left").select("vec_id", "number", "node", F.coalesce("component", "node").alias("component"))
    named = common.materialise(named, "named")
    first = named.groupBy("component").agg(F.min("vec_id").alias("component_id"), F.count("*").alias("size")).where("size > 1")
    whole = nodes.where("weight > 1").select(F.col("number").alias("node"), "weight")
    told = named.join(first, "component", "left").join(links.withColumnRenamed("number", "node"), "node", "left").join(whole, "node", "left")
    told = told.select("number", F.coalesce("component_id", "vec_id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1).alias("n_links"))
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    made = named.select("number", "vec_id").join(told, "number").select("vec_id", "n_links", "component_id").unionByName(alone)
    return made.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"), F.lit(recall).alias("recall"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0
), p AS MATERIALIZED (
  SELECT a.vec_id, b.vec_id AS other FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    AND list_dot_product(a.e, b.e) >= 0.95 * sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))
), r AS (
  SELECT vec_id, vec_id AS node FROM v UNION SELECT r.vec_id, p.other FROM r JOIN p ON r.node = p.vec_id
), c AS (SELECT vec_id, min(node) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT vec_id, count(*) AS n_links FROM p GROUP BY vec_id)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, coalesce(c.component_id, e.vec_id) AS component_id,
  coalesce(coalesce(c.component_id, e.vec_id) = e.vec_id, false) AS kept
FROM embeddings e LEFT JOIN c ON e.vec_id = c.vec_id LEFT JOIN n ON e.vec_id = n.vec_id
"""
