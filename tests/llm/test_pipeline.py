"""The pipeline on the smallest tables against the operators' brute-force versions."""

import sys

import corpus_pipeline
from fixtures import docs
from test_decontaminate import words
from test_lines import deleted
from test_near import plain as classes


def test_stages(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    stage = dict(corpus_pipeline.STAGES)
    toxic = stage["toxicity"](spark, table, sf_dir)
    assert toxic.columns == table.columns
    marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    gone = {r[0] for r in table.select("doc_id").collect()} - {r[0] for r in toxic.select("doc_id").collect()}
    assert all(marks.get(i, 1) == 1 for i in gone)

    rows = [(r["doc_id"], r["text"]) for r in toxic.collect()]
    clean = stage["line dedup"](spark, toxic, sf_dir)
    want, out = deleted(rows), []
    for key, text in rows:
        cut = want.get((key, text), set())
        left = "\n".join(t for i, t in enumerate((text or "").split("\n")) if i not in cut)
        if not cut or left.strip(" "):
            out.append((key, left, len(left)))
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in clean.collect()) == sorted(out)
    assert clean.columns == table.columns

    own = [(k, t) for k, t, _ in out]
    one = stage["n-gram Jaccard join"](spark, docs(spark, own), sf_dir)
    kept = {k for k, c, _ in classes(own) if k == c}
    assert {r["doc_id"] for r in one.collect()} == kept

    items = [words(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    windows = {tuple(w[i:i + 10]) for w in items for i in range(max(1, len(w) - 9)) if w}
    left = stage["benchmark decontamination"](spark, one, sf_dir)
    want = {k for k, t in own if k in kept and not any(
        tuple(words(t)[i:i + n]) in windows for n in {len(x) for x in windows} for i in range(len(words(t)) - n + 1))}
    assert {r["doc_id"] for r in left.collect()} == want

    mixed = stage["mixing sources to target weights"](spark, left, sf_dir)
    assert {r["doc_id"] for r in mixed.collect()} == want and mixed.columns[:5] == table.columns


def test_run_is_the_stages(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and all(r["rate"] > 0 for r in rows)


def test_entry_has_the_queries():
    import __spark_entry__ as entry
    names = list(entry.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names) and "parley.llm" in sys.modules
