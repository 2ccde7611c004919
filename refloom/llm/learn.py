"""Small models fitted on a bounded labelled sample: the sample, L-BFGS, and the two likelihoods used here."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most about so many labelled documents are used to fit a model; they are chosen by a hash of doc_id.
MAX_LABELLED = 6000


def labelled_sample(docs: DataFrame, labels: DataFrame, values: list[str], limit: int = MAX_LABELLED) -> DataFrame:
    """``(doc_id, text, *values)`` of about ``limit`` labelled documents, all if there are fewer.

    Labels with a null are left out; of repeated labels of a document the smallest values count, of repeated rows of a
    document the smallest text, so the rows are no more than the chosen labels. These number about ``limit`` whatever the
    input, so they are broadcast.
    """
    known = labels.dropna(subset=["doc_id", *values]).groupBy("doc_id").agg(*(F.min(v).alias(v) for v in values))
    total = known.count()
    part = min(1.0, limit / max(1, total))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(part * (1 << 30)))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", *values).agg(F.min("text").alias("text"))


def lbfgs(loss, x: np.ndarray, rounds: int = 100, memory: int = 8) -> np.ndarray:
    """Minimum of ``loss(x) -> (value, gradient)`` by L-BFGS with a backtracking line search."""
    value, g = loss(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, used = -g, []
        for s, y in reversed(steps):
            a = s @ d / (s @ y)
            used.append(a)
            d = d - a * y
        if steps:
            s, y = steps[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(used)):
            d = d + (a - y @ d / (s @ y)) * s
        slope, t = g @ d, 1.0 if steps else 1.0 / max(1.0, np.abs(g).sum())
        while True:
            new, h = loss(x + t * d)
            if new <= value + 1e-4 * t * slope or t < 1e-10:
                break
            t /= 2
        s, y = t * d, h - g
        if s @ y > 1e-12:
            steps = [*steps[1 - memory :], (s, y)]
        done = value - new < 1e-8 * max(1.0, abs(value))
        x, value, g = x + s, new, h
        if done:
            break
    return x


class Sparse:
    """A matrix of few entries a row, as far as fitting needs one: ``x @ w`` and ``x.T @ r``."""

    def __init__(self, at: list[np.ndarray], value: list[np.ndarray], columns: int):
        self.shape = len(at), columns
        self.at, self.value = (np.concatenate([np.zeros(0, t), *parts]) for t, parts in ((np.int32, at), (np.float64, value)))
        self.row = np.repeat(np.arange(len(at), dtype=np.int32), [len(a) for a in at])

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.value * w[self.at], minlength=self.shape[0])

    @property
    def T(self):
        return _Transposed(self)


class _Transposed:
    def __init__(self, of: Sparse):
        self.of = of

    def __matmul__(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.of.at, weights=self.of.value * r[self.of.row], minlength=self.of.shape[1])


def sigmoid(z):
    return 0.5 * (1 + np.tanh(0.5 * z))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic model, the last one its intercept."""

    def loss(w):
        z = x @ w[:-1] + w[-1]
        value = np.logaddexp(0, z).sum() - y @ z + 0.5 * ridge * (w[:-1] @ w[:-1])
        r = sigmoid(z) - y
        return value, np.r_[x.T @ r + ridge * w[:-1], r.sum() + 1e-3 * w[-1]]

    return lbfgs(loss, np.zeros(x.shape[1] + 1))


def fit_ordinal(x: np.ndarray, grade: np.ndarray, grades: int, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Cumulative-link model: P(grade > j) = sigmoid(w·x - theta_j), thetas increasing. Returns (w, theta)."""
    d, k = x.shape[1], grades - 1

    def thetas(p):
        return p[d] + np.r_[0, np.cumsum(np.exp(p[d + 1 :]))]

    def loss(p):
        w, th = p[:d], thetas(p)
        s = x @ w
        above = np.c_[np.ones(len(s)), sigmoid(s[:, None] - th), np.zeros(len(s))]  # P(grade >= j), j = 0..grades
        rows = np.arange(len(s))
        prob = np.maximum(above[rows, grade] - above[rows, grade + 1], 1e-12)
        slope = above * (1 - above)
        up, down = slope[rows, grade] / prob, slope[rows, grade + 1] / prob
        g_s = down - up  # of the negative log-likelihood by s
        g_th = np.zeros(k)
        np.add.at(g_th, np.clip(grade - 1, 0, k - 1), np.where(grade > 0, up, 0))
        np.add.at(g_th, np.clip(grade, 0, k - 1), np.where(grade < k, -down, 0))
        gaps = np.exp(p[d + 1 :])
        rest = np.cumsum(g_th[::-1])[::-1]
        value = -np.log(prob).sum() + 0.5 * ridge * (w @ w) + 1e-3 * (p[d:] @ p[d:])
        return value, np.r_[x.T @ g_s + ridge * w, np.r_[rest[0], gaps * rest[1:]] + 2e-3 * p[d:]]

    p = lbfgs(loss, np.zeros(d + k))
    return p[:d], thetas(p)
