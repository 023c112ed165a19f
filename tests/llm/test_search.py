"""Norm-bucketed search against brute force over all pairs."""

import math
import random

import numpy as np
import pytest

from parley.llm import search, vectors

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, k=search.K, every=search.EVERY, scale=search.SCALE):
    """Answers by the definition: all products, sorted."""
    kept = [(i, [math.floor(x * scale) for x in v]) for i, v, *_ in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, left) in enumerate(kept):
        if q is None or q % every:
            continue
        found = [(search.nearest_long(sum(x * y for x, y in zip(left, right))), i) for b, (i, right) in enumerate(kept)
                 if a != b and len(left) == len(right)]
        found.sort(key=lambda f: (-f[0], f[1] is None, f[1] or 0))
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out, key=repr)


def answers(spark, rows, more=(), **options):
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in more:
        frame = frame.selectExpr("*", f"'x' AS {name}")
    found = search.top_k(frame, **options)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


def drawn(n, dim, seed, spread=1.0):
    """Vectors around a few directions, of lengths that differ by orders of magnitude with `spread`."""
    r = np.random.default_rng(seed)
    centre = r.normal(size=(5, dim))
    out = []
    for i in range(n):
        v = centre[i % 5] + 0.3 * r.normal(size=dim)
        v *= math.exp(spread * r.normal()) / np.linalg.norm(v)
        out.append((i, [float(x) for x in v], i % 3))
    return out


@pytest.mark.parametrize("dim,spread", [(8, 1.5), (16, 0.0), (3, 0.5)])
def test_same_as_brute_force(spark, dim, spread):
    rows = drawn(700, dim, dim, spread)
    assert answers(spark, rows) == brute(rows)


def test_many_cells_give_the_same(spark):
    rows = drawn(400, 6, 1)
    want = brute(rows)
    for queries, slices in ((3, 1), (5, 7), (1_000, 1)):
        assert answers(spark, rows, queries=queries, slices=slices) == want


def test_hot_vector_and_ties(spark):
    same = [0.5, -0.25, 0.125]
    rows = [(i, same, 0) for i in range(300)] + [(300 + i, [0.0, 0.0, 0.0], 0) for i in range(60)]
    rows += [(400, [-1.0, -1.0, -1.0], 0), (40, same, 1), (40, same, 1)]
    random.Random(1).shuffle(rows)
    assert answers(spark, rows, slices=3) == brute(rows)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (20, None, 1), (40, [1.0, None], 1), (60, [nan, 1.0], 1), (80, [inf, 1.0], 1),
            (100, [], 1), (120, [], 1), (140, [1.0], 1), (160, [3.0], 1), (None, [1.0, 2.0], None), (7, [1.0, 2.0], None),
            (-20, [-1.0, -2.0], 1), (180, [0.0, 0.0], 1), (5, [1e-9, -1e-9], 1)]
    assert answers(spark, rows, more=["rank", "score", "row", "block", "slice", "dim", "norm"]) == brute(rows)
    assert answers(spark, []) == []
    assert answers(spark, [(1, [1.0], 0)]) == []
    assert answers(spark, [(0, [1.0], 0)]) == []


def test_very_large_components(spark):
    rows = [(20 * i, [float(x) for x in v], 0) for i, v in enumerate(
        [[1e6, 3.0], [1e6, 2.0], [-1e9, 1e9], [2e9, 1.0], [1e15, -1e15], [123456789.0, 7.0], [0.5, 0.25]])]
    assert answers(spark, rows, k=4) == brute(rows, k=4)


def test_buckets_end_by_rows_and_by_length():
    norms = np.array([10, 10, 9.5, 9.0, 8.9, 5, 5, 5, 0, 0.0])
    assert search.cut_buckets(norms, size=2, ratio=0.9) == [2, 4, 5, 7, 8, 10]
    assert search.cut_buckets(norms, size=100, ratio=0.9) == [4, 5, 8, 10]
    assert search.cut_buckets(np.array([])) == []


def test_interval_holds_every_vector_above_the_threshold():
    r = np.random.default_rng(3)
    for _ in range(200):
        q, p = r.normal(size=(2, 5))
        q, p = q / np.linalg.norm(q), p / np.linalg.norm(p)
        if q @ p > 0:
            low, high = search.interval(q, q @ p)
            assert (low <= p).all() and (p <= high).all()


def cell_and_buckets(matrix, ids, size):
    norms = np.linalg.norm(matrix, axis=1)
    order = np.argsort(-norms, kind="stable")
    matrix, norms, ids = matrix[order], norms[order], ids[order]
    ends = search.cut_buckets(norms, size)
    return [search.Bucket(ids[a:b], ids[a:b], norms[a:b], matrix[a:b]) for a, b in zip([0, *ends], ends)]


def test_length_prunes_short_vectors():
    r = np.random.default_rng(5)
    matrix = np.floor(r.normal(size=(2_000, 8)) * np.exp(r.normal(size=(2_000, 1)) * 2) * 64)
    buckets = cell_and_buckets(matrix, np.arange(2_000), 200)
    at = np.arange(0, 2_000, 20)
    cell = search.Cell(at, at, np.linalg.norm(matrix[at], axis=1), matrix[at], 5)
    for b in buckets:
        cell.meet(b)
    assert cell.verified < 0.3 * len(at) * len(matrix)


def test_coordinates_prune_where_thresholds_are_high():
    """Every query has near copies of its own length, so thresholds on the cosine are near 1."""
    r = np.random.default_rng(6)
    centre = r.normal(size=(200, 16))
    matrix = np.repeat(centre / np.linalg.norm(centre, axis=1)[:, None], 10, axis=0)
    matrix = np.floor(64 * 16 * matrix)
    buckets = cell_and_buckets(matrix, np.arange(2_000), 500)
    at = np.arange(0, 2_000, 20)
    cell = search.Cell(at, at, np.linalg.norm(matrix[at], axis=1), matrix[at], 5)
    for b in buckets:
        cell.meet(b)
    dense = len(at) * len(matrix)
    assert cell.verified < dense
    scores = matrix[at] @ matrix.T
    scores[np.arange(len(at)), at] = -np.inf
    assert (cell.score == -np.sort(-scores, axis=1)[:, :5]).all()


@pytest.mark.parametrize("dim", [0, 1, 5])
def test_packing_round_trip(dim):
    rows = np.array([[0] * dim, [127] * dim, [-128] * dim, [300] * dim, [-40_000] * dim, [float(1 << 60)] * dim])
    rows = rows.reshape(6, dim).astype(float)
    assert (vectors.unpack(list(vectors.pack(rows)), dim) == rows).all()
