"""The classifier chain: held-out accuracy, its linear algebra, and the awkward rows."""

import numpy as np
from fixtures import CLASHES, awkward, docs, labels, prose

from parley.llm import linear, toxicity

BAD = ["scumbo", "trashka", "idiolo", "morodo"]


def corpus(n=400):
    rows, marks = [], []
    for i in range(n):
        text, toxic, poor = prose(i, 60), i % 5 == 0, i % 7 == 0
        if poor:
            text = " ".join(w + "%%%" for w in text.split())
        if toxic:
            w = text.split()
            w[3 + i % 20], w[30] = BAD[i % 4], BAD[(i + 1) % 4]
            text = " ".join(w)
        rows.append((i, text))
        marks.append((i, int(not poor), int(toxic)))
    return rows, marks


def test_held_out(spark):
    rows, marks = corpus()
    found = toxicity.report(docs(spark, rows), labels(spark, marks[:200])).collect()
    for r in found:
        assert r["toxic"] == (r["doc_id"] % 5 == 0)
        assert (r["p_low_quality"] > 0.5) == (r["doc_id"] % 7 == 0)


def test_later_models_see_earlier_ones(spark):
    rows, marks = corpus(150)
    known, models = toxicity.train(docs(spark, rows), labels(spark, marks))
    assert [len(w) for w, _ in models] == [len(known) + toxicity.N_RATES, len(known) + toxicity.N_RATES + 1]
    text = rows[0][1]
    own = toxicity._Features(known)
    p = toxicity.score(text, own, [(np.array(w), b) for w, b in models])
    at, dense = toxicity.numbers(text, own), toxicity.rates(text)
    (w1, b1), (w2, b2) = models
    z1 = b1 + sum(w1[i] for i in at) + np.dot(w1[len(known):], dense)
    z2 = b2 + sum(w2[i] for i in at) + np.dot(w2[len(known):-1], dense) + w2[-1] * np.clip(z1, -10, 10)
    assert np.allclose(p, [1 / (1 + np.exp(-z1)), 1 / (1 + np.exp(-z2))])


def test_logistic_regression_is_at_its_minimum():
    r = np.random.default_rng(0)
    dense = (r.random((300, 12)) < 0.3) * r.random((300, 12))
    y = (dense[:, 0] + dense[:, 1] + 0.3 * r.random(300) > 0.6).astype(float)
    x = linear.Sparse.of_rows([np.flatnonzero(d) for d in dense], 12, [d[d != 0] for d in dense])
    w, b = linear.fit_logistic(x, y, 0.5, rounds=5000, tolerance=1e-9)
    error = linear.sigmoid(dense @ w + b) - y
    assert np.abs(dense.T @ error + 0.5 * w).max() < 1e-3 and abs(error.sum()) < 1e-3


def test_awkward(spark):
    rows, marks = corpus(100)
    table = docs(spark, rows + [(1000 + (k or 0), t) for k, t in awkward()] + [(None, None)], CLASHES + ["p_toxic"])
    found = toxicity.classify(table, labels(spark, marks + [(None, 1, 1), (5000, None, None), (3, 1, 0)]))
    got = found.collect()
    assert len(got) == table.count() and all(0 <= r["p_toxic"] <= 1 for r in got)
    left = toxicity.remove_toxic(table, labels(spark, marks))
    assert left.columns[:5] == table.columns[:5]
    assert {r["doc_id"] for r in left.collect() if r["doc_id"] is not None and r["doc_id"] < 100} == {
        i for i in range(100) if i % 5}


def test_no_labels_and_no_documents(spark):
    table = docs(spark, [(1, "a b"), (2, None), (3, "")])
    assert {r["p_toxic"] for r in toxicity.classify(table, labels(spark, [])).collect()} == {0.5}
    assert toxicity.remove_toxic(table, labels(spark, [(1, 1, 0), (3, 1, 0)])).count() == 3
    assert toxicity.report(docs(spark, []), labels(spark, [(1, 1, 0)])).collect() == []
