"""Searches over vectors, against brute force."""

import math

import numpy as np
import pytest

from plumbline.llm import blocks, neighbours, topk

SCHEMA = "vec_id long, embedding array<float>, e string, score int"


def table(spark, n=700, dims=12, seed=0):
    rng = np.random.default_rng(seed)
    vectors = rng.standard_normal((n, dims)).astype(np.float32)
    vectors[n // 3 : n // 2] = vectors[5]  # one very common vector
    rows = [(i, v.tolist(), "x", 1) for i, v in enumerate(vectors)]
    odd = [None, [], [0.0] * dims, [math.nan] + [1.0] * (dims - 1), [None] + [1.0] * (dims - 1), [math.inf] * dims, [1.0] * 3]
    rows += [(10_000 + 50 * i, v, None, None) for i, v in enumerate(odd)] + [(None, [1.0] * dims, None, None)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def usable(v, zero):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))


def brute(rows, measure, zero, k=5):
    held = [(i, np.array(v, float)) for i, v, *_ in rows if i is not None and usable(v, zero)]
    out = {}
    for i, v in held:
        if i % 50 == 0:
            scored = [(-measure(v, w), j) for j, w in held if j != i and len(w) == len(v)]
            out[i] = [(j, -s) for s, j in sorted(scored)[:k]]
    return out


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_exact_products(spark):
    rows, df = table(spark)
    scaled = lambda v: np.floor(256 * v)
    wanted = {k: v for k, v in brute(rows, lambda a, b: int(scaled(a) @ scaled(b)), True).items() if v}
    assert collected(topk.top_products(df)) == wanted


def test_neighbours_found(spark):
    rows, df = table(spark)
    cosine = lambda a, b: float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))
    wanted = {k: v for k, v in brute(rows, cosine, False).items() if v}
    made = collected(neighbours.nearest(df))
    assert set(made) == set(wanted)
    hits = total = 0
    for q, found in made.items():
        vectors = {i: np.array(v, float) for i, v, *_ in rows if usable(v, False)}
        assert all(abs(s - cosine(vectors[q], vectors[j])) < 1e-12 for j, s in found)
        least = wanted[q][-1][1]
        hits += sum(s >= least - 1e-12 for _, s in found)
        total += len(wanted[q])
    assert hits >= 0.9 * total


@pytest.mark.parametrize("search", [topk.top_products, neighbours.nearest])
def test_few_rows(spark, search):
    empty = spark.createDataFrame([], SCHEMA)
    assert search(empty).collect() == []
    two = spark.createDataFrame([(0, [1.0, 2.0], "", 0), (1, [2.0, 1.0], "", 0)], SCHEMA)
    assert [(r.query_id, r["rank"], r.vec_id) for r in search(two).collect()] == [(0, 1, 1)]
    alone = spark.createDataFrame([(0, [1.0], "", 0)], SCHEMA)
    assert search(alone).collect() == []


def test_index_keeps_all_possible_members():
    rng = np.random.default_rng(1)
    rows = rng.integers(-300, 300, (500, 20))
    queries = rng.integers(-300, 300, (30, 20))
    block, fifth = topk.Block(np.arange(500), rows, 5), np.sort(queries @ rows.T, axis=1)[:, -5].astype(float)
    for least in (None, fifth):
        for query, members in zip(queries, block.members(queries.astype(float), 6, least), strict=True):
            scores = rows @ query
            wanted = scores >= (np.sort(scores)[-6] if least is None else np.sort(scores)[-5])
            assert set(np.flatnonzero(wanted)) <= set(members.tolist())
            assert least is None or len(members) < 400


@pytest.mark.parametrize("dims", [1, 3, 20])
def test_boxes_bound_what_their_leaves_hold(dims):
    rng = np.random.default_rng(3)
    rows, queries = rng.integers(-300, 300, (400, dims)), rng.integers(-300, 300, (30, dims))
    space = topk.Products(5)
    there, asked = space.project(rows), space.project(queries)
    leaf = blocks.Planes(there, 7).of(there)
    assert len(np.unique(leaf)) == 7
    for n in np.unique(leaf):
        far = space.bounds(asked, there[leaf == n].min(axis=0)[None], there[leaf == n].max(axis=0)[None])
        most = (queries @ rows[leaf == n].T).max(axis=1)
        assert space.open(far, most[:, None].astype(float)).all()


def test_many_rounds_blocks_and_groups(spark, monkeypatch):
    """Repeated ids and equal vectors, in blocks of 50 rows and groups of few visitors, against brute force."""
    for name, value in (("LEAF_ROWS", 40), ("BLOCK_ROWS", 50), ("VISITORS", 7), ("AT_ONCE", 5), ("SAMPLE", 200)):
        monkeypatch.setattr(blocks, name, value)
    rng = np.random.default_rng(8)
    rows = [(int(n), (rng.standard_normal(6) + 4 * (n % 3)).astype(np.float32).tolist(), "", 0) for n in range(500)]
    rows += [(50, rows[7][1], "", 0)] * 300 + [(1000 + n, rows[7][1], "", 0) for n in range(200)]
    wanted = {}
    held = [(i, np.floor(256 * np.array(v, float))) for i, v, *_ in rows]
    for i in sorted({i for i, _ in held if i % 50 == 0}):
        asked = min(tuple(v) for j, v in held if j == i)
        wanted[i] = [(j, -s) for s, j in sorted((-int(np.dot(asked, w)), j) for j, w in held if j != i)[:5]]
    assert collected(topk.top_products(spark.createDataFrame(rows, SCHEMA))) == wanted
    near = collected(neighbours.nearest(spark.createDataFrame(rows[:500], SCHEMA)))
    brute_near = brute(rows[:500], lambda a, b: float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))), False)
    hits = sum(len({j for j, _ in near[q]} & {j for j, _ in brute_near[q]}) for q in brute_near)
    assert set(near) == set(brute_near) and hits >= 0.9 * 5 * len(brute_near)


def test_chi_square_stops_early():
    """On vectors of low intrinsic dimension a query verifies a small share of the rows, and finds its neighbours."""
    rng = np.random.default_rng(6)
    rows = rng.standard_normal((6000, 5)) @ rng.standard_normal((5, 64)) + 0.05 * rng.standard_normal((6000, 64))
    block, unit = neighbours.Block(np.arange(6000), rows, 5, neighbours.CONFIDENCE), rows / np.linalg.norm(rows, axis=1, keepdims=True)
    seen = hits = 0
    for name, ids, scores in block.search(np.arange(40), rows[:40], np.full(40, -np.inf)):
        cosines = unit @ unit[name]
        cosines[name] = -2
        seen += len(ids)
        hits += len(set(ids[np.argsort(-scores)[:5]].tolist()) & set(np.argsort(-cosines)[:5].tolist()))
    assert hits >= 0.9 * 200 and seen < 0.25 * 40 * 6000


def test_tree_gives_points_in_ascending_batches():
    points = np.random.default_rng(2).standard_normal((1000, 4))
    seen, last = [], 0.0
    for bound, batch, _ in neighbours.KdTree(points).ascending(points[0]):
        far = ((points[batch] - points[0]) ** 2).sum(axis=1)
        assert (far <= bound).all() and (far >= last - 1e-12).all()
        seen += batch.tolist()
        last = bound
    assert sorted(seen) == list(range(1000))
