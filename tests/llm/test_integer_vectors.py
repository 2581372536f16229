"""Vector codes and centroid clusters, against plain integers."""

import hashlib
import math

import numpy as np
import pytest

from plumbline.llm import centroids, codes, lattice

SCHEMA = "vec_id long, embedding array<float>, label int, `e` string, `a.b` int, Vec_Ids int"


def vectors(n=300, dims=64, seed=0):
    rng = np.random.default_rng(seed)
    made = (rng.standard_normal((n, dims)) / 8).astype(np.float32)
    made[n // 3 : 2 * n // 3] = made[5]  # a very common vector
    made[-20:, :32] = made[5, :32]  # equal parts of different vectors
    rows = [(i, v.tolist(), [None, 1, 2][i % 3], "x", 1, 2) for i, v in enumerate(made)]
    odd = [None, [], [math.nan] + [1.0] * (dims - 1), [None] + [1.0] * (dims - 1), [math.inf] * dims, [3e30] * dims, [1.0] * 3, [1.0] * (dims * 2)]
    rows += [(10_000 + i, v, 7, None, None, None) for i, v in enumerate(odd)] + [(None, made[7].tolist(), 1, "x", 1, 2), rows[3], rows[3]]
    return rows


def usable(v, dims, scale):
    return v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(x * scale) < lattice.LIMIT for x in v)


def whole(rows, dims, scale, order):
    held = [(i, [math.floor(scale * x) for x in v], label) for i, v, label, *_ in rows if usable(v, dims, scale)]
    return sorted(held, key=order)


def digest(numbers):
    return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


def lloyd(points, centres, rounds):
    far = lambda p, c: sum((a - b) ** 2 for a, b in zip(p, c, strict=True))
    nearest = lambda p: min(range(len(centres)), key=lambda j: (far(p, centres[j]), j))
    for _ in range(rounds):
        own = [nearest(p) for p in points]
        for j in set(own):
            mine = [p for p, o in zip(points, own, strict=True) if o == j]
            centres[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    own = [nearest(p) for p in points]
    return own, [far(p, centres[o]) for p, o in zip(points, own, strict=True)], centres


def brute_codes(rows, parts=16, entries=64, rounds=2):
    held = whole(rows, 64, 256, lambda r: (r[0] is None, r[0] or 0, r[1]))
    width, code, error, books = 64 // parts, [""] * len(held), [0] * len(held), []
    for at in range(parts):
        points = [e[at * width : (at + 1) * width] for _, e, _ in held]
        own, far, book = lloyd(points, [list(p) for p in points[:entries]], rounds)
        code, error = [c + f"{o:02x}" for c, o in zip(code, own, strict=True)], [a + b for a, b in zip(error, far, strict=True)]
        books += [x for entry in book for x in entry]
    by = {}
    for (_, _, label), far in zip(held, error, strict=True):
        by[label] = by.get(label, 0) + far
    key = lambda r: (r[0] is None, *map(str, r))
    return sorted([(i, c, far, by[label], digest(books)) for (i, _, label), c, far in zip(held, code, error, strict=True)], key=key)


def brute_clusters(rows, k=16, rounds=3):
    name = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    held = whole(rows, 64, 64, lambda r: (r[0] is None, name(r[0]), r[1]))
    points = [e for _, e, _ in held]
    own, far, centres = lloyd(points, [list(p) for p in points[:k]], rounds)
    by = {}
    for o, f in zip(own, far, strict=True):
        by[o] = by.get(o, 0) + f
    return sorted([(i, o, f, by[o], sum(far), digest(centres[o])) for (i, _, _), o, f in zip(held, own, far, strict=True)], key=str)


@pytest.mark.parametrize("batch", [codes.BATCH, 16])
def test_codes(spark, monkeypatch, batch):
    monkeypatch.setattr(codes, "BATCH", batch)
    rows = vectors()
    made = codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert made.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted([tuple(r) for r in made.collect()], key=lambda r: (r[0] is None, *map(str, r))) == brute_codes(rows)


def test_codes_of_few_vectors(spark):
    rows = vectors(12)[:12]
    made = codes.compress(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, made.collect()), key=lambda r: (r[0] is None, *map(str, r))) == brute_codes(rows)


def test_equal_parts_become_one_row(spark):
    rows = spark.createDataFrame([(n, n // 40, [1, 2, n % 2, 0]) for n in range(80)], "number long, block long, e array<int>")
    held = codes.split(rows, 2).collect()
    assert len(held) <= 4 + 2 * 4 * 2 and sum(r.weight for r in held) == 160  # per batch: one part at 0, two at 1


def test_clusters(spark):
    rows = vectors()
    made = centroids.cluster(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert sorted([tuple(r)[:-1] for r in made.collect()], key=str) == brute_clusters(rows)


def test_empty_and_useless_tables(spark):
    for rows in ([], [r for r in vectors() if r[1] is None or len(r[1]) < 16]):
        table = spark.createDataFrame(rows, SCHEMA)
        assert codes.compress(table).collect() == [] and centroids.cluster(table).collect() == []


def test_bounds_skip_and_ties_stay_exact():
    """Clustered points and many ties: the result is that of all distances, with a part of them calculated."""
    rng = np.random.default_rng(4)
    points = rng.integers(-3, 4, (600, 6)) + 40 * rng.integers(0, 3, (600, 1))
    centres = points[:9].copy()
    centres[3] = centres[1]  # a tie everywhere
    held = centroids.Bounds.first(points, centres)
    for turn in range(6):
        far = lattice.squared(points, centres)
        assert (held.cluster == far.argmin(axis=1)).all()
        near = far[np.arange(600), held.cluster]
        assert (held.upper**2 >= near).all() and (held.lower**2 <= far).all()
        before, centres = centres, centres + rng.integers(-2, 3, centres.shape) * (turn % 2)
        held = centroids.Bounds(points, held.cluster, held.upper, held.lower)
        held.moved(before, centres)
        held.assign(centres)
        assert held.counted.sum() < 0.5 * 600 * 9


def test_distances_are_exact_for_large_components():
    rng = np.random.default_rng(5)
    for size in (1 << 10, lattice.LIMIT - 1):
        a, b = rng.integers(-size, size, (20, 64)), rng.integers(-size, size, (7, 64))
        wanted = [[sum((int(x) - int(y)) ** 2 for x, y in zip(p, c, strict=True)) for c in b] for p in a]
        assert lattice.squared(a, b).tolist() == wanted
