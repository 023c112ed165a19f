"""Code compression against a plain loop that scans every entry in every round."""

import hashlib
import math

import numpy as np
import pytest

from parley.llm import codebooks

SCHEMA = "vec_id long, embedding array<double>, label string"


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """(vec_id, code, error, label_error, digest) by the definition, in Python's numbers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])
            and len(r[1]) and len(r[1]) % parts == 0]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    if not kept:
        return []
    width = len(kept[0][1]) // parts
    whole = [[math.floor(x * scale) for x in r[1]] for r in kept]
    cut = [[w[p * width:(p + 1) * width] for p in range(parts)] for w in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            mine = [nearest(c[p], books[p])[1] for c in cut]
            for e in range(len(books[p])):
                own = [c[p] for c, m in zip(cut, mine) if m == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    error = [sum(f[0] for f in fs) for fs in found]
    total = {}
    for r, e in zip(kept, error):
        total[r[2]] = total.get(r[2], 0) + e
    most = codebooks.LONG
    return sorted(((r[0], "".join(f"{f[1]:02x}" for f in fs), min(e, most), min(total[r[2]], most), digest)
                   for r, fs, e in zip(kept, found, error)), key=repr)


def compressed(spark, rows, more=()):
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in more:
        frame = frame.selectExpr("*", f"'x' AS {name}")
    found = codebooks.report(frame)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


def drawn(n, dim, seed):
    r = np.random.default_rng(seed)
    return [(i, [float(x) for x in r.normal(size=dim)], f"l{i % 4}" if i % 5 else None) for i in range(n)]


@pytest.mark.parametrize("dim", [8, 32])
def test_same_as_plain_loop(spark, dim):
    rows = drawn(400, dim, dim)
    assert compressed(spark, rows) == brute(rows)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = drawn(30, 8, 2)
    bad = [(100, None, "a"), (101, [None] + [1.0] * 7, "a"), (102, [nan] * 8, "a"), (103, [inf] * 8, "a"), (104, [], "a"),
           (105, [1.0] * 7, "a"), (106, [1.0] * 16, "b")]
    twice = [(3, good[3][1], "x"), (3, good[4][1], None), (None, good[5][1], "y"), (50, [0.0] * 8, "y")]
    rows = good + bad + twice
    assert compressed(spark, rows, more=["code", "error", "dim", "packed", "bounds", "sums"]) == brute(rows)
    assert compressed(spark, []) == []
    assert compressed(spark, [(1, None, "a")]) == []


def test_few_rows_ties_and_equal_vectors(spark):
    assert compressed(spark, drawn(1, 8, 3)) == brute(drawn(1, 8, 3))
    assert compressed(spark, drawn(5, 16, 4)) == brute(drawn(5, 16, 4))
    rows = [(i, [float(i % 2)] * 8, "a") for i in range(60)]  # entries that are equal: the lower index counts
    assert compressed(spark, rows) == brute(rows)


def test_very_large_components(spark):
    rows = [(i, [x * 10.0 ** (i % 12) for x in v], label) for i, v, label in drawn(60, 8, 5)]
    assert compressed(spark, rows) == brute(rows)


def test_label_without_many_rows_is_joined(spark):
    """More labels than hot ones: sums come by the broadcast and by the join."""
    rows = [(i, v, "hot" if i % 3 == 0 else f"own{i}") for i, v, _ in drawn(1_500, 8, 6)]
    assert compressed(spark, rows) == brute(rows)


def rounds_of(vectors, parts, entries, rounds):
    """Bounds, books and scanned parts of each round, next to a full scan."""
    whole = np.floor(vectors * 4096).astype(np.int64)
    cut = whole.reshape(len(whole), parts, -1)
    books, bounds, scanned = [cut[:entries].transpose(1, 0, 2).copy()], None, []
    for _ in range(rounds):
        bounds, _, n = codebooks.assign(whole, bounds, codebooks.History(books))
        scanned.append(n)
        for p in range(parts):
            full = codebooks.squares(cut[:, p], books[-1][p]).argmin(axis=1)
            assert (bounds[:, p]["entry"] == full).all()
        sums = codebooks.Sums(books[-1].shape)
        sums.add(whole, bounds)
        new = books[-1].copy()
        for p, e in zip(*np.nonzero(sums.n)):
            new[p, e] = [int(x) // int(sums.n[p, e]) for x in sums.total[p, e]]
        books.append(new)
    return scanned


def test_bounds_save_scans_and_change_nothing():
    r = np.random.default_rng(7)
    centre = r.normal(size=(16, 32)) * 3
    vectors = centre[r.integers(0, 16, 2_000)] + 0.1 * r.normal(size=(2_000, 32))
    scanned = rounds_of(vectors, 8, 16, 6)
    assert scanned[0] == 2_000 * 8
    assert scanned[-1] < 0.5 * scanned[0]


def test_net_moves_are_not_longer_than_the_way():
    r = np.random.default_rng(8)
    books = [r.integers(-100, 100, (2, 4, 3)) for _ in range(5)]
    history = codebooks.History(books)
    steps = [np.sqrt(np.square((b - a).astype(float)).sum(axis=2)) for a, b in zip(books, books[1:])]
    for t in range(4):
        assert (history.moved[t] <= sum(steps[t:]) * (1 + 1e-6)).all()
    assert (history.moved[-1] == 0).all()
    assert history.others[0, 1, 2] == max(history.moved[0, 1, e] for e in (0, 1, 3))
