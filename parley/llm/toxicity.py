"""Toxicity by a chain of linear classifiers.

The categories of the label table are predicted one after the other. Each is a logistic
regression over the words of a document, the first letters of its words, and a few rates;
it also gets the log odds that the earlier models of the chain give. For the training rows
these come from models fitted without the row's fold, so a later model sees them as they
will be for new documents. Fitting uses at most `sample` labelled documents and
`features` word features; predicting reads every document whole.

Defined results: null and empty texts have no features and get the probabilities of the
bias; without labels, or with one class only, a category has the same probability
everywhere (0.5 without labels) and rejects nothing; repeated rows give one row each; of
repeated labels for an id the first in order counts; an empty table gives an empty one.
"""

import re

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import map_arrow
from parley.llm.linear import Sparse, fit_logistic, folds

SAMPLE_DOCS = 12_000
FEATURES = 8_000
#: Least chi-square score of a feature; chance alone hardly reaches it in any of many words.
MIN_SCORE = 20.0
FOLDS = 4
#: Letters at the beginning of a word that are a feature of their own.
HEAD = 4
PENALTY = 0.2
THRESHOLD = 0.5
#: Category and the SQL that gives its mark from a label row; a chain in this order.
CATEGORIES = (("low_quality", "1 - quality"), ("toxic", "toxic"))

_WORD = re.compile(r"\w+")
_SYMBOL = re.compile(r"[^\w\s.,]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
N_RATES = 4


def rates(text):
    """Dense values of a text, each about 0 to 1."""
    size = max(1, len(text))
    tokens = text.split()
    return (min(1.0, 10 * len(_SYMBOL.findall(text)) / size), len(_UPPER.findall(text)) / size,
            len(set(tokens)) / len(tokens) if tokens else 0.0, min(1.0, len(tokens) / 50))


class _Features(dict):
    """Word to its features that have a number; forgets all when it is full."""

    def __init__(self, numbers):
        self.numbers = numbers

    def __missing__(self, word):
        if len(self) >= 1 << 19:
            self.clear()
        found = self[word] = tuple(
            n for n in map(self.numbers.get, ("w " + word, "h " + word[:HEAD]) if len(word) >= HEAD else ("w " + word,))
            if n is not None)
        return found


def names(text):
    """Names of the word features of a text."""
    found = set(_WORD.findall(text.lower()))
    return {"w " + w for w in found} | {"h " + w[:HEAD] for w in found if len(w) >= HEAD}


def numbers(text, known):
    """Sorted numbers of the features in a text."""
    return sorted({n for w in set(_WORD.findall(text.lower())) for n in known[w]})


def labelled(docs: DataFrame, labels: DataFrame, categories, sample: int) -> DataFrame:
    """doc_id, text and y0.. of at most `sample` labelled documents, chosen by a hash of their id."""
    marks = [F.expr(f"cast({sql} as int)").alias(f"y{i}") for i, (_, sql) in enumerate(categories)]
    chosen = (labels.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("__id"), *marks).dropna()
              .groupBy("__id").agg(*[F.max(f"y{i}").alias(f"y{i}") for i in range(len(categories))])
              .orderBy(F.xxhash64("__id"), "__id").limit(sample))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).drop("__id")


def select_features(rows: DataFrame, n_categories: int, features: int):
    """The `features` names with the largest chi-square score for any category, at least MIN_SCORE;
    names of fewer than 4 documents are left out."""
    def found(batch):
        out = [[] for _ in range(1 + n_categories)]
        for text, *marks in zip(*(c.to_pylist() for c in batch.columns)):
            own = names(text or "")
            out[0] += own
            for column, mark in zip(out[1:], marks):
                column += [mark] * len(own)
        return out
    ys = [f"y{i}" for i in range(n_categories)]
    counts = map_arrow(rows.select("text", *ys), found, "name string, " + ", ".join(f"{y} int" for y in ys))
    total = rows.agg(F.count(F.lit(1)), *[F.sum(y) for y in ys]).first()
    n = float(total[0])
    score = [F.lit(0.0)]
    for y, positive in zip(ys, total[1:]):
        share = (positive or 0) / n if n else 0.0
        if 0 < share < 1:
            expected = F.col("n") * share
            score.append((F.col(y) - expected) ** 2 / (expected * (1 - share)))
    best = F.greatest(*score, F.lit(-1.0))
    top = (counts.groupBy("name").agg(F.count(F.lit(1)).alias("n"), *[F.sum(y).alias(y) for y in ys])
           .filter("n >= 4").select("name", best.alias("score")).filter(F.col("score") >= MIN_SCORE).orderBy(F.desc("score"), "name").limit(features))
    return {r[0]: i for i, r in enumerate(top.collect())}


def train(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, sample: int = SAMPLE_DOCS,
          features: int = FEATURES):
    """The chain: known features, and per category (weights, bias) over features, rates and earlier log odds."""
    from parley.session import cut_lineage
    ys = [f"y{i}" for i in range(len(categories))]
    rows = cut_lineage(labelled(docs, labels, categories, sample))
    known = select_features(rows, len(ys), features)
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def vector(batch):
        cache = _Features(shared.value)
        ids, texts, *marks = (c.to_pylist() for c in batch.columns)
        return [ids, [numbers(t or "", cache) for t in texts], [list(rates(t or "")) for t in texts], *marks]
    schema = "doc_id long, f array<int>, r array<double>, " + ", ".join(f"{y} int" for y in ys)
    found = map_arrow(rows.select("doc_id", "text", *ys), vector, schema).toArrow()  # at most `sample` rows
    found = found.take(np.argsort(found["doc_id"].to_numpy(), kind="stable"))
    ids, n, k = found["doc_id"].to_pylist(), found.num_rows, len(known)
    lengths = pc.list_value_length(found["f"]).to_numpy()
    column, dense = pc.list_flatten(found["f"]).to_numpy(), pc.list_flatten(found["r"]).to_numpy()
    x = Sparse(np.r_[np.repeat(np.arange(n), lengths), np.repeat(np.arange(n), N_RATES)].astype(np.int64),
               np.r_[column, np.tile(np.arange(k, k + N_RATES), n)].astype(np.int64),
               np.r_[np.ones(len(column)), dense], (n, k + N_RATES))
    fold, models = folds(ids, FOLDS), []
    for i in range(len(ys)):
        y = found[ys[i]].to_numpy().astype(float)
        models.append(fit_logistic(x, y, PENALTY))
        odds = np.zeros(n)
        for part in range(FOLDS if i + 1 < len(ys) else 0):
            out = np.flatnonzero(fold == part)
            w, b = fit_logistic(x.take(np.flatnonzero(fold != part)), y[fold != part], PENALTY)
            odds[out] = x.take(out).dot(w) + b
        x = x.plus(np.clip(odds, -10, 10))
    return known, [(w.tolist(), b) for w, b in models]


def score(text, known, models):
    """Probabilities of the categories for one text."""
    own, dense, odds, out = numbers(text, known), rates(text), [], []
    at = len(known.numbers)
    for w, b in models:
        z = b + w[own].sum() + np.dot(w[at:at + N_RATES], dense) + np.dot(w[at + N_RATES:], odds)
        odds.append(min(10.0, max(-10.0, float(z))))
        out.append(1.0 / (1.0 + float(np.exp(-min(40.0, max(-40.0, z))))))
    return out


def predict(docs: DataFrame, model, categories=CATEGORIES) -> DataFrame:
    """The rows of `docs` with all columns and p_<category> for every category."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = [f"p_{name}" for name, _ in categories]
    kept = [c for c in docs.columns if c not in new]
    rows = docs.select(*kept)
    at = kept.index("text")
    from pyspark.sql.types import DoubleType, StructType
    kind = StructType(list(rows.schema.fields))
    for name in new:
        kind = kind.add(name, DoubleType())
    import pyarrow as pa
    state = {}

    def run(batches):
        known, models = shared.value
        cache = state.setdefault("cache", _Features(known))
        models = [(np.array(w), b) for w, b in models]
        for batch in batches:
            found = [score(t or "", cache, models) for t in batch.column(at).cast(pa.string()).to_pylist()]
            columns = [pa.array([f[i] for f in found], pa.float64()) for i in range(len(models))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *new])
    return rows.mapInArrow(run, kind)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return predict(docs, train(docs, labels))


def report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, p_low_quality, p_toxic and toxic of every row."""
    found = classify(docs.select("doc_id", "text"), labels)
    return found.select("doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") > threshold).alias("toxic"))


def remove_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that are not toxic, with their columns."""
    return classify(docs, labels).filter(F.col("p_toxic") <= threshold).select(*docs.columns)
