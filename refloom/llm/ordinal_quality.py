"""Operator 10: a quality classifier by ordinal cumulative-link regression on graded ratings.

The rating of a labelled document has three grades: 0 low quality, 1 good but toxic, 2 good and not toxic. One weight
vector over hashed text features is shared by all grades; ordered thresholds turn its score into P(grade > j), which
gives the expected grade and the tail probability for selection: P(grade >= 1) of at least KEEP_FROM keeps a document.
A document's white-space-separated tokens are hashed twice: lower-cased into WORDS buckets, and as their shapes (letters,
capitals, digits and marks with runs collapsed), with immediate repetitions, into BUCKETS buckets before them; the
features are the square roots of the shares, so length plays no part.

Fitted on a bounded sample of labelled documents (learn.MAX_LABELLED); applied to whole texts of all documents.
Defined cases: a null or empty text has no features and is judged by the thresholds alone; without labelled documents,
or if all have one grade, that grade (2 without any) is certain; a null doc_id is kept as null; repeated rows are judged
alike; other columns, whatever their names, are ignored by ``judge`` and kept by ``select``; an empty table gives an empty
result; texts are read whole, however long.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import partial
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .learn import Sparse, fit_ordinal, labelled_sample, sigmoid

GRADES, BUCKETS, WORDS, KEEP_FROM = 3, 1024, 2048, 0.5
#: The bucket of tokens that repeat the token before them.
AGAIN = 0
MEMORY, LONGEST = 50_000, 64
_RULES = [(re.compile(p), r) for p, r in ((r"[^\W\d_]+", lambda m: ("X" if m[0].isupper() and len(m[0]) > 1 else "Xx" if m[0][0].isupper() else "x")), (r"\d+", "9"), (r"([^\w])\1+", r"\1\1"))]


class Shapes(dict):
    """Token → buckets of its shape and of itself; a bounded part is remembered."""

    def __missing__(self, token: str) -> tuple[int, int]:
        shape = token
        for pattern, to in _RULES:
            shape = pattern.sub(to, shape)
        got = zlib.crc32(shape.encode()) % BUCKETS, BUCKETS + zlib.crc32(token.lower().encode()) % WORDS
        if len(token) <= LONGEST:
            if len(self) >= MEMORY:
                self.clear()
            self[token] = got
        return got


_SHAPES = Shapes()


def features(text: str | None) -> tuple[list[int], list[float]]:
    """Buckets and values of a text."""
    words = (text or "").split()
    counts, total = {}, len(words)
    for word, n in Counter(words).items():
        a, b = _SHAPES[word]
        counts[a] = counts.get(a, 0) + n
        counts[b] = counts.get(b, 0) + n
    if again := sum(map(eq, words, words[1:])):
        counts[AGAIN] = counts.get(AGAIN, 0) + again
    return list(counts), [(n / total) ** 0.5 for n in counts.values()]


def _features(batches):
    """Buckets and values of each text, packed: the driver gets them all."""
    for batch in batches:
        got = [features(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([pa.array([np.array(b, np.uint16).tobytes() for b, _ in got], pa.binary()), pa.array([np.array(v, np.float32).tobytes() for _, v in got], pa.binary()), batch.column(0)], ["at", "value", "grade"])


class OrdinalQuality:
    """weights: by bucket; thresholds: increasing, one fewer than the grades."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > j) for each j."""
        return sigmoid(scores[:, None] - self.thresholds)


def fit(docs: DataFrame, labels: DataFrame) -> OrdinalQuality:
    sample = labelled_sample(small_batches(docs), labels, ["quality", "toxic"]).selectExpr("case when quality = 0 then 0 when toxic = 1 then 1 else 2 end as grade", "text")
    rows = sample.mapInArrow(_features, "at binary, value binary, grade int").collect()  # bounded by MAX_LABELLED; a few bytes for each distinct word
    rows.sort(key=lambda r: (r["grade"], bytes(r["at"]), bytes(r["value"])))
    grades = np.array([r["grade"] for r in rows], np.int64)
    if len(set(grades.tolist())) < 2:
        sure = int(grades[0]) if len(grades) else GRADES - 1
        return OrdinalQuality(np.zeros(BUCKETS + WORDS), np.array([-50.0 if j < sure else 50.0 for j in range(GRADES - 1)]))
    x = Sparse([np.frombuffer(r["at"], np.uint16).astype(np.int32) for r in rows], [np.frombuffer(r["value"], np.float32).astype(float) for r in rows], BUCKETS + WORDS)
    return OrdinalQuality(*fit_ordinal(x, grades, GRADES, ridge=0.05))


def _judge(batches, model, keep_from):
    weights = model.weights
    for batch in batches:
        scores = np.zeros(batch.num_rows)
        for i, t in enumerate(batch.column(1)):
            at, value = features(t.as_py())
            scores[i] = sum(weights[b] * v for b, v in zip(at, value))
        tails = model.tails(scores)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(axis=1)), pa.array(tails[:, 0]), pa.array(tails[:, 0] >= keep_from)], ["doc_id", "expected_grade", "p_good", "keep"])


def judge(docs: DataFrame, model: OrdinalQuality, keep_from: float = KEEP_FROM) -> DataFrame:
    """``(doc_id, expected_grade, p_good, keep)``, one row per row of ``docs``."""
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_judge, model=model, keep_from=keep_from), "doc_id long, expected_grade double, p_good double, keep boolean")


def _select(batches, model, keep_from, text):
    for batch in batches:
        scores = np.zeros(batch.num_rows)
        for i, t in enumerate(batch.column(text)):
            at, value = features(t.as_py())
            scores[i] = sum(model.weights[b] * v for b, v in zip(at, value))
        yield batch.filter(pa.array(model.tails(scores)[:, 0] >= keep_from))


def select(docs: DataFrame, model: OrdinalQuality, keep_from: float = KEEP_FROM) -> DataFrame:
    """The documents kept, all columns as they are, in one pass and without a shuffle."""
    return small_batches(docs).mapInArrow(partial(_select, model=model, keep_from=keep_from, text=docs.columns.index("text")), docs.schema)
