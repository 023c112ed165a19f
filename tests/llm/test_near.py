"""The Jaccard join against all pairs, with blocks small enough to be met."""

import random

import pytest
from fixtures import CLASHES, awkward, docs, prose
from test_decontaminate import words

from parley.llm import components, near


def plain(rows, threshold=0.8):
    """(doc_id, class_id, n_links) per row, by comparing all distinct texts."""
    texts = list(dict.fromkeys(t for _, t in rows if t is not None))
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up, n = list(range(len(texts))), [0] * len(texts)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
                n[i] += 1
                n[j] += 1
                up[root(i)] = root(j)
    ids = {}
    for key, t in rows:
        if t is not None:
            r = root(texts.index(t))
            ids.setdefault(r, []).append(key)
    least = {r: min((k for k in ks if k is not None), default=None) for r, ks in ids.items()}
    return sorted(((k, k, 0) if t is None else (k, least[root(texts.index(t))], n[texts.index(t)]) for k, t in rows),
                  key=repr)


def check(spark, rows, more=(), **options):
    found = near.near_duplicates(docs(spark, rows, more), **options).select("doc_id", "class_id", "n_links").collect()
    assert sorted((tuple(r) for r in found), key=repr) == plain(rows)


def copies(seed, n, changes, length=80):
    r, base = random.Random(seed), prose(seed, length).split()
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(r.randrange(changes + 1)):
            own[r.randrange(len(own))] = f"w{r.randrange(1000)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("block", [512, 7])
def test_groups(spark, block):
    texts = copies(1, 40, 4) + copies(2, 3, 1) + [prose(100 + i, 60) for i in range(30)] + copies(3, 12, 2, 25)
    rows = [(1000 - i, t) for i, t in enumerate(texts)] + [(2000 + i, texts[0]) for i in range(25)]
    check(spark, rows, block=block)


def test_awkward(spark):
    rows = awkward() + [(40, "One!"), (41, "..."), (42, "..."), (43, "a b c"), (44, "A b, c"), (None, prose(1, 80).upper())]
    check(spark, rows, CLASHES)


def test_empty(spark):
    check(spark, [])
    check(spark, [(1, None), (None, None)])


def test_one_stays(spark):
    rows = docs(spark, [(3, prose(1, 60)), (2, prose(1, 60) + "."), (5, prose(2, 60)), (None, None), (7, None),
                        (2, "another text")], CLASHES)
    left = near.keep_one(rows)
    assert left.columns == rows.columns
    assert sorted(((r["doc_id"], (r["text"] or "")[:5]) for r in left.collect()), key=repr) == sorted(
        [(2, prose(1, 60)[:5]), (5, prose(2, 60)[:5]), (None, ""), (7, ""), (2, "anoth")], key=repr)


def test_one_row_of_each_class_stays(spark):
    """Also where rows repeat, rows of a class share the least id, or have none."""
    one, two, three, four = (prose(i, 60) for i in (11, 12, 13, 14))
    rows = [(4, one), (4, one + " x"), (4, "y " + one), (9, two), (9, two), (9, two), (None, three), (None, three),
            (None, four), (6, four + " z"), (None, None), (None, None), (8, None), (1, ""), (1, ""), (2, "")]
    left = near.keep_one(docs(spark, rows, CLASHES)).collect()
    texts = sorted((r["doc_id"], r["text"]) for r in left if r["doc_id"] is not None and r["text"] is not None)
    assert [k for k, _ in texts] == [1, 4, 6, 9] and texts[1][1] in (one, one + " x", "y " + one)
    assert [texts[0][1], texts[2][1], texts[3][1]] == ["", four + " z", two]
    assert sorted(str(r["text"]) for r in left if r["doc_id"] is None) == sorted([three, "None", "None"])
    assert len(left) == 8


def test_bands():
    n = near.bands_for()
    assert 1 - (1 - 0.8 ** near.ROWS) ** n >= near.RECALL > 1 - (1 - 0.8 ** near.ROWS) ** (n - 1)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 120), (120, 110), (7, 7)] + [(200, 201 + i) for i in range(20)]
    found = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    want = {i: 0 for i in range(31)} | {100: 100, 110: 100, 120: 100} | {200 + i: 200 for i in range(21)}
    assert {r["node"]: r["root"] for r in found} == want and len(found) == len(want)
