"""Small linear models that are fitted on bounded samples."""

import numpy as np


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


class Sparse:
    """A matrix as entries (row, column, value); the sums over equal places count."""

    def __init__(self, row, column, value, shape):
        self.row, self.column, self.value, self.shape = row, column, value, shape

    @classmethod
    def of_rows(cls, rows, n_features, values=None):
        """From lists of feature numbers per row, with values or all 1."""
        lengths = [len(r) for r in rows]
        flat = lambda parts, kind: np.concatenate([np.asarray(p, kind) for p in parts]) if len(parts) else np.zeros(0, kind)
        column = flat(rows, np.int64)
        value = np.ones(len(column)) if values is None else flat(values, float)
        return cls(np.repeat(np.arange(len(rows)), lengths), column, value, (len(rows), n_features))

    def plus(self, values):
        """With one more column."""
        n, d = self.shape
        return Sparse(np.r_[self.row, np.arange(n)], np.r_[self.column, np.full(n, d)], np.r_[self.value, values], (n, d + 1))

    def take(self, rows):
        """The given rows, in their order."""
        place = np.full(self.shape[0], -1)
        place[rows] = np.arange(len(rows))
        keep = place[self.row] >= 0
        return Sparse(place[self.row[keep]], self.column[keep], self.value[keep], (len(rows), self.shape[1]))

    def dot(self, weights):
        return np.bincount(self.row, self.value * weights[self.column], self.shape[0])

    def sums(self, per_row):
        return np.bincount(self.column, self.value * per_row[self.row], self.shape[1])


def fit_logistic(x: Sparse, y, penalty=1.0, rounds=400, tolerance=1e-4):
    """(weights, bias) of a logistic regression with an L2 penalty, by accelerated gradient steps
    scaled per feature. With one class only, the bias is all there is."""
    n, d = x.shape
    y = np.asarray(y, float)
    share = (y.sum() + 0.5) / (n + 1.0)
    w, b = np.zeros(d), float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        return w, b
    # A row's features move together, so steps shrink with the number of features in a row.
    per_row = np.maximum(np.bincount(x.row, np.abs(x.value), n), 1.0)
    curve = 0.25 * np.bincount(x.column, np.abs(x.value) * (per_row[x.row] + 1.0), d) + penalty
    curve_b = 0.25 * float((per_row + 1.0).sum())
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(rounds):
        error = sigmoid(x.dot(vw) + vb) - y
        nw = vw - (x.sums(error) + penalty * vw) / curve
        nb = vb - error.sum() / curve_b
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        moved = max(np.abs(nw - w).max(initial=0.0), abs(nb - b))
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
        if moved < tolerance:
            break
    return w, float(b)


def folds(keys, n):
    """Fold of each row from its own key, so equal keys share a fold."""
    return np.array([hash(k) % n if isinstance(k, int) else 0 for k in keys], np.int64)
