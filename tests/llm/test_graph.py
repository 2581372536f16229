"""Near-duplicate vectors by a pruned graph, against brute force."""

import math

import numpy as np
import pytest

from plumbline.llm import graph

SCHEMA = "vec_id long, embedding array<float>, label int, `e` string, `a.b` int, Number int"


def unit(v):
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def vectors(n=900, dims=32, seed=0):
    """Random vectors, groups of near copies of 2 to n/4, exact copies, a chain, and odd rows."""
    rng = np.random.default_rng(seed)
    made = unit(rng.standard_normal((n, dims)))
    at = 0
    for size in (2, 5, 30, n // 4):
        made[at : at + size] = unit(made[at] + 0.13 / math.sqrt(dims) * rng.standard_normal((size, dims)))
        at += size
    for k in range(at, at + 12):  # neighbours link, the ends do not
        made[k + 1] = unit(made[k] + 0.25 / math.sqrt(dims) * rng.standard_normal(dims))
    made = made.astype(np.float32)
    made[-50:] = made[-51]
    made[-10:] *= 2  # of one direction, not equal
    made = made[rng.permutation(n)]
    rows = [(int(7 * i % 1009), v.tolist(), 1, "x", 1, 2) for i, v in enumerate(made)]
    odd = [None, [], [0.0] * dims, [math.nan] + [1.0] * (dims - 1), [None] + [1.0] * (dims - 1), [math.inf] * dims]
    rows += [(5000 + i, v, None, None, None, None) for i, v in enumerate(odd)] + [(None, rows[0][1], 1, "", 0, 0), rows[1], rows[1]]
    return rows + [(6000 + i, [1.0, float(i)], 0, "", 0, 0) for i in (0, 9, 10)]


def usable(r):
    return r[0] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])


def brute(rows, least=0.95):
    held = [(r[0], unit(np.array(r[1], float))) for r in rows if usable(r)]
    near = [[j for j, (_, w) in enumerate(held) if j != i and len(v) == len(w) and v @ w >= least] for i, (_, v) in enumerate(held)]
    part = list(range(len(held)))
    while True:
        now = [min([part[i], *(part[j] for j in near[i])]) for i in range(len(held))]
        if now == part:
            break
        part = now
    first = {}
    for p, (name, _) in zip(part, held, strict=True):
        first[p] = min(name, first.get(p, name))
    out = [(name, len(n), first[p], name == first[p]) for (name, _), n, p in zip(held, near, part, strict=True)]
    return out + [(r[0], 0, r[0], r[0] is not None) for r in rows if not usable(r)]


def rows_of(df):
    return sorted([tuple(r)[:4] for r in df.collect()], key=str)


@pytest.mark.parametrize("cell", [graph.CELL, 120])
def test_links_and_components(spark, monkeypatch, cell):
    """In one cell, and in many overlapping ones, a group of near copies being larger than a cell."""
    monkeypatch.setattr(graph, "CELL", cell)
    rows = vectors()
    made = graph.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3))
    made, wanted = rows_of(made), sorted(brute(rows), key=str)
    assert sorted(str(r[0]) for r in made) == sorted(str(r[0]) for r in wanted)
    found, there = sum(r[1] for r in made), sum(r[1] for r in wanted)
    assert 0.98 * there <= found <= there
    if cell == graph.CELL:
        assert made == wanted
    groups = lambda rows: {r[0]: r[2] for r in rows}
    assert sum(groups(made)[k] == v for k, v in groups(wanted).items()) >= 0.98 * len(groups(wanted))


def test_recall_is_audited_and_the_beam_widened(spark, monkeypatch):
    """A search that finds nothing is told by the audit and tried again."""
    beams, search = [], graph._search
    monkeypatch.setattr(graph, "_search", lambda least, beam: beams.append(beam) or search(2.0 if len(beams) < 2 else least, beam))
    made = graph.near_duplicates(spark.createDataFrame(vectors(), SCHEMA)).collect()
    assert beams == [graph.BEAM, 2 * graph.BEAM] and made[0].recall >= graph.RECALL


def test_empty_and_useless_tables(spark):
    assert graph.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [r for r in vectors() if not usable(r)]
    assert rows_of(graph.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == sorted(brute(rows), key=str)


def test_graph_is_flat_and_found_from_the_medoid():
    rng = np.random.default_rng(3)
    points = unit(rng.standard_normal((40, 16)))[rng.integers(0, 40, 1500)]
    points = unit(points + 0.1 * rng.standard_normal(points.shape))
    made = graph.Graph(points)
    assert made.links.shape == (1500, graph.DEGREE) and not (made.links == np.arange(1500)[:, None]).any()
    asked = unit(points[::10] + 0.02 * rng.standard_normal((150, 16)))
    ids, seen = made.walk(asked.astype(np.float32), graph.BEAM)
    best = (asked @ points.T).argmax(axis=1)
    assert (ids == best[:, None]).any(axis=1).mean() > 0.9 and seen.mean() < 0.5
    met = np.concatenate([hits for _, hits in made.reach(asked, None, 0.95, graph.BEAM)])
    wanted = asked @ points.T >= 0.95
    assert not (met & ~wanted).any() and met.sum() >= 0.95 * wanted.sum()


def test_pruning_leaves_out_whom_a_kept_one_covers():
    points = unit(np.array([[1, 0, 0], [1, 0.1, 0], [1, 0.11, 0], [1, 0, 0.1]], float))
    made = graph.Graph(points)
    kept = made._prune(np.array([0]), np.array([[1, 2, 3, 1, 0, -1]]))[0]
    assert kept[kept >= 0].tolist() in ([1, 3], [3, 1])
