"""Mixing: the classifier on held-out documents, the fit against numpy, and the awkward rows."""

import numpy as np
from fixtures import CLASHES, awkward, docs, labels, prose

from parley.llm import mixing


def corpus(spark, n=120, more=()):
    """Two domains with words of their own; every second document is labelled."""
    rows, marks = [], []
    for i in range(n):
        good = i % 3 != 0
        text = prose(i, 30, 60) if good else prose(i, 20, 60).upper().replace("A", "X") + " # # #"
        rows.append((i, text))
        if i % 2:
            marks.append((i, int(good), 0))
    return docs(spark, rows, more), labels(spark, marks)


def test_posteriors_of_held_out_documents(spark):
    table, marks = corpus(spark)
    found = mixing.mix(table, marks).collect()
    assert all((r["domain"] == "en/good") == (r["doc_id"] % 3 != 0) for r in found)


def test_fit_against_numpy(spark):
    r = np.random.default_rng(3)
    p = r.dirichlet([0.4] * 4, 300)
    n, m = r.integers(0, 200, 300), r.integers(1, 3, 300)
    rows = spark.createDataFrame([(int(a), int(b), *map(float, q)) for a, b, q in zip(m, n, p)],
                                 "m long, n long, p0 double, p1 double, p2 double, p3 double")
    target = [4000.0, 9000.0, 100.0, 12000.0]
    found, totals, _ = mixing.fit(rows, lambda now: target, rounds=40)
    got = {(x["m"], x["n"], x["p0"]): x["r"] for x in found.collect()}
    rate, mass = np.ones(300), n * m
    start = (mass[:, None] * p).sum(0)
    for _ in range(40):
        now = (mass[:, None] * p * rate[:, None]).sum(0)
        if max(abs(now - target) / start) < 1e-6:
            break
        rate = np.maximum(0, rate - p @ ((now - target) / start))
    assert np.allclose([got[int(a), int(b), float(q[0])] for a, b, q in zip(m, n, p)], rate, atol=1e-9)
    assert min(got.values()) >= 0
    loss = lambda x: float((((mass[:, None] * p * x[:, None]).sum(0) - target) ** 2 / start).sum())
    assert loss(rate) < 0.05 * loss(np.ones(300)) and np.allclose(totals, (mass[:, None] * p * rate[:, None]).sum(0))


def test_targets_are_met(spark):
    table, marks = corpus(spark)
    found = mixing.rates(table, marks, lambda now: [sum(now) / 2] * 2).collect()
    totals = {}
    for r in found:
        for name, p in r["p"].items():
            totals[name] = totals.get(name, 0) + r["rate"] * r["n"] * p
    assert np.allclose(totals["en/good"], totals["en/poor"], rtol=1e-3)


def test_awkward(spark):
    rows = awkward()
    table = docs(spark, rows, CLASHES)
    marks = labels(spark, [(5, 1, 0), (8, 0, 1), (8, 1, 1), (None, 1, 0), (6, None, None), (99, 1, 1)])
    found = mixing.mix(table, marks)
    assert [c for c in table.columns if c not in ("rate", "domain")] == found.columns[:-3]
    got = found.collect()
    assert len(got) == len(rows) and all(r["rate"] >= 0 for r in got)
    tokens = {(r["doc_id"], r["text"]): r["n_tokens"] for r in got}
    assert all(tokens[k, t] == len([w for w in (t or "").replace("\n", " ").split(" ") if w]) for k, t in rows)
    assert len({r["rate"] for r in got if r["doc_id"] == 5}) == 1


def test_no_labels_and_no_documents(spark):
    table = docs(spark, [(1, "a b"), (2, None)])
    assert {r["rate"] for r in mixing.mix(table, labels(spark, [])).collect()} == {1.0}
    assert mixing.mix(docs(spark, []), labels(spark, [(1, 1, 0)])).collect() == []


def test_documents_without_a_language(spark):
    table = docs(spark, [(i, f"a b c d{i}") for i in range(6)]).drop("lang")
    marks = labels(spark, [(i, i % 2, 0) for i in range(4)])
    found = mixing.mix(table, marks).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(6))
    assert {r["domain"] for r in found} <= {"und/good", "und/poor"} and "lang" not in found[0].asDict()
    assert len(mixing.report(table, marks).collect()) == 6


def test_no_python_in_the_plan(spark, sf_dir):
    from parley.llm import lines
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for frame in (mixing.report(table, marks), lines.report(table)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
