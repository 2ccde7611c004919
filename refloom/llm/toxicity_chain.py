"""Operator 5: toxicity by a classifier chain.

The categories are judged in order. Each has a linear model over the presence and density of hashed words (32-bit hashes
of lower-cased words and of their beginnings, those kept that tell the category best in the training rows) and over the
probabilities of the categories before it; while fitting, those probabilities are out-of-fold ones. The table labels only the last category,
`toxic`. The earlier ones are weak labels: a document labelled toxic that has a word of the category's list; a list only
says what a category is about, and the words a model uses are learned. A document is rejected if P(toxic) is at least
REJECT_FROM.

Fitted on a bounded sample of labelled documents (learn.MAX_LABELLED); applied to whole texts of all documents.
Defined cases: a null or empty text has no words, and the intercepts judge it; without toxic labels every probability
is about 0, and without labels exactly 0; a null doc_id is kept as null; repeated rows are judged alike; other columns,
whatever their names, are ignored by ``judge`` and kept by ``select``; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches
from .learn import fit_logistic, labelled_sample, sigmoid

REJECT_FROM, FOLDS, KEPT_WORDS = 0.5, 3, 256
PREFIXES, CANDIDATES = (4, 5, 7), 4096
MEMORY, LONGEST = 200_000, 64
#: Hashes of texts that a worker holds at once, and entries of the sample that the driver looks at at once.
HELD, CHUNK = 200_000, 1 << 20
#: What a word counts: PRESENT, and more the denser it is, per DENSITY words; short texts count as SHORT words longer.
PRESENT, DENSITY, SHORT = 0.3, 200, 20
#: What the weakly labelled categories are about.
CATEGORIES = {
    "insult": "idiot moron stupid dumb fool loser clown imbecile jerk".split(),
    "degradation": "trash scum garbage filth vermin worthless useless subhuman".split(),
    "contempt": "pathetic disgusting despicable revolting repulsive hateful vile".split(),
}
NAMES = [*CATEGORIES, "toxic"]
_WORD = re.compile(r"\w+")


def forms(word: str) -> list[int]:
    """Hashes of a word and of its beginnings of PREFIXES letters, so that unseen forms of a stem are told too."""
    return [zlib.crc32(word.encode()), *(zlib.crc32(f"{word[:n]}-".encode()) for n in PREFIXES if len(word) > n)]


def value(count: int, total: int) -> float:
    """The feature of a hash that ``count`` of a text's ``total`` words have."""
    return PRESENT + math.log1p(DENSITY * count / (total + SHORT))


def word_hashes(text: str | None, known=None) -> dict[int, float]:
    """Values of the hashes of a text, of those that ``known`` gives for a word if it is given."""
    words, counts = Counter(_WORD.findall((text or "").lower())), {}
    for w, n in words.items():
        for h in forms(w) if known is None else known[w]:
            counts[h] = counts.get(h, 0) + n
    total = words.total()
    return {h: value(n, total) for h, n in counts.items()}


def _hashes(batches):
    """Hashes of each text and their values, and its labels by category: the weak ones, then that of the table."""
    lists = [{zlib.crc32(w.encode()) for w in ws} for ws in CATEGORIES.values()]

    def out(toxic, words):
        weak = [pa.array([t if any(h in s for h, _ in w) else 0 for t, w in zip(toxic, words)], pa.int32()) for s in lists]
        lists_ = [pa.array([[x[k] for x in w] for w in words], pa.list_(t)) for k, t in enumerate((pa.int64(), pa.float64()))]
        return pa.RecordBatch.from_arrays([*lists_, *weak, pa.array(toxic, pa.int32())], ["words", "of", *NAMES])

    for batch in batches:
        toxic, words, held = [], [], 0
        for t, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            toxic.append(int(bool(t)))
            words.append(sorted(word_hashes(text.as_py()).items()))
            held += len(words[-1])
            if held >= HELD:
                yield out(toxic, words)
                toxic, words, held = [], [], 0
        if words:
            yield out(toxic, words)


def _within(batches, known):
    """What the driver gets of each row: the places in ``known``, sorted, of its hashes that are there, and their values, packed
    such that bytes sort as numbers do; before them a hash of these hashes, which orders the rows."""
    for batch in batches:
        order, at, of = [], [], []
        for w, x in zip(batch.column(0), batch.column(1)):
            hashes = w.values.to_numpy()
            use = np.isin(hashes, known)
            order.append(zlib.crc32(repr(hashes[use].tolist()).encode()))
            at.append(np.searchsorted(known, hashes[use]).astype(_AT).tobytes())
            of.append(x.values.to_numpy()[use].astype(_OF).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(order, pa.int64()), pa.array(at, pa.binary()), pa.array(of, pa.binary()), *batch.columns[2:]], ["order", "at", "of", *NAMES])


#: Places of CANDIDATES, and values, as they reach the driver.
_AT, _OF = ">u2", ">f8"


class _Presence:
    """Which of the hashes in at least 2 rows each row has, as positions, and their values."""

    def __init__(self, ids: np.ndarray, at: list[np.ndarray], value: list[np.ndarray]):
        """ids: sorted hashes; at, value: of each row, the positions in ids of its hashes and their values."""
        sizes, kind = [len(a) for a in at], np.min_scalar_type(len(ids))
        self.n, self.at = len(at), np.concatenate([np.zeros(0, kind), *at], dtype=kind, casting="unsafe")
        self.row = np.repeat(np.arange(self.n, dtype=np.min_scalar_type(self.n)), sizes)
        self.value = np.concatenate([np.zeros(0), *value], dtype=float)
        often = np.bincount(self.at, minlength=len(ids)) >= 2
        if not often.all():
            use = often[self.at]
            self.at, self.row, self.value = (np.cumsum(often) - 1)[self.at[use]], self.row[use], self.value[use]
        self.ids = ids[often]

    @classmethod
    def of(cls, words: list[dict[int, float]]):
        ids, at = np.unique(np.array([h for w in words for h in w], np.int64), return_inverse=True)
        ends = np.cumsum([len(w) for w in words])[:-1]
        return cls(ids, np.split(at, ends) if words else [], [np.array([*w.values()], float) for w in words])

    def _parts(self):
        return (slice(k, k + CHUNK) for k in range(0, len(self.at), CHUNK))

    def best(self, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Positions of the KEPT_WORDS hashes with the largest chi-square for y in ``rows``; ties to the smaller hash."""
        inside = np.zeros(self.n, bool)
        inside[rows] = True
        n, pos = len(rows), y[rows].sum()
        df, hit = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids))
        for part in self._parts():
            use = inside[self.row[part]]
            at = self.at[part][use]
            df += np.bincount(at, minlength=len(self.ids))
            hit += np.bincount(at, weights=y[self.row[part][use]], minlength=len(self.ids))
        with np.errstate(divide="ignore", invalid="ignore"):
            chi = n * (hit * n - df * pos) ** 2 / (df * (n - df) * pos * (n - pos))
        chi = np.where((df >= 2) & np.isfinite(chi) & (hit * n > df * pos), chi, 0)
        order = np.lexsort((self.ids, -chi))[:KEPT_WORDS]
        return order[chi[order] > 0]

    def matrix(self, kept: np.ndarray) -> np.ndarray:
        place, x = np.full(len(self.ids), -1), np.zeros((self.n, len(kept)))
        place[kept] = np.arange(len(kept))
        for part in self._parts():
            use = place[self.at[part]] >= 0
            x[self.row[part][use], place[self.at[part][use]]] = self.value[part][use]
        return x


class Link:
    """One model of the chain: word weights by hash, weights of the earlier probabilities, intercept."""

    def __init__(self, words: _Presence, rows: np.ndarray, y: np.ndarray, before: np.ndarray):
        kept = words.best(rows, y) if len(rows) else np.zeros(0, int)
        x = np.c_[words.matrix(kept), before]
        w = fit_logistic(x[rows], y[rows], ridge=0.3) if len(rows) else np.r_[np.zeros(x.shape[1]), -50.0]
        self.fitted = sigmoid(x @ w[:-1] + w[-1])
        self.words, self.before, self.intercept = dict(zip(words.ids[kept].tolist(), w.tolist())), w[len(kept) : -1].tolist(), float(w[-1])

    def p(self, values, before) -> float:
        z = self.intercept + sum(self.words.get(h, 0.0) * v for h, v in values) + sum(a * b for a, b in zip(self.before, before))
        return float(sigmoid(z))


class Chain:
    def __init__(self, words: list[dict[int, float]] | _Presence, labels: np.ndarray):
        """words: hashes of each row and their values; labels: rows × categories, the last the label of the table."""
        presence = words if isinstance(words, _Presence) else _Presence.of(words)
        n = presence.n
        fold, out_of_fold = np.arange(n) % FOLDS, np.zeros((n, 0))
        self.links: list[Link] = []
        for c in range(labels.shape[1]):
            y = labels[:, c].astype(float)
            self.links.append(Link(presence, np.arange(n), y, out_of_fold))
            p = np.zeros(n)
            for k in range(FOLDS if c + 1 < labels.shape[1] else 0):
                p[fold == k] = Link(presence, np.flatnonzero(fold != k), y, out_of_fold).fitted[fold == k]
            out_of_fold = np.c_[out_of_fold, p]
        for link in self.links:
            del link.fitted
        self.known = {h for link in self.links for h in link.words}

    def judge(self, words: dict[int, float]) -> list[float]:
        """Probabilities of all categories for a text's hashes and their values."""
        values, out = sorted((h, v) for h, v in words.items() if h in self.known), []
        for link in self.links:
            out.append(link.p(values, out))
        return out


def fit(docs: DataFrame, labels: DataFrame) -> Chain:
    """The chain fitted on the sample. Words are counted on the executors; the driver gets the CANDIDATES words that tell
    some category best, and which of them each sampled document has."""
    fields = f"words array<bigint>, of array<double>, {', '.join(f'{n} int' for n in NAMES)}"
    sample = labelled_sample(small_batches(docs), labels, ["toxic"]).selectExpr("cast(toxic as int) as toxic", "text")
    rows = cut(sample.mapInArrow(_hashes, fields), "toxic-sample")
    n, *positive = rows.agg(F.count("*"), *(F.coalesce(F.sum(c), F.lit(0)) for c in NAMES)).first()
    counts = rows.select(F.explode("words").alias("h"), *NAMES).groupBy("h").agg(F.count("*").alias("df"), *(F.sum(c).alias(c) for c in NAMES)).filter("df >= 2")
    chi = [F.expr(f"if({c} * {n}L > df * {p}L, power({c} * {n}D - df * {p}D, 2) * {n}D / (df * ({n}D - df) * {p}D * ({n}D - {p}D)), 0D)") for c, p in zip(NAMES, positive) if 0 < p < n]
    found = counts.filter(f"df < {n}").select("h", F.greatest(F.lit(0.0), *chi, F.lit(0.0)).alias("chi")).filter("chi > 0") if chi else None
    known = np.array(sorted(r["h"] for r in found.orderBy(F.desc("chi"), "h").limit(CANDIDATES).collect()) if chi else [], np.int64)
    packed = rows.mapInArrow(partial(_within, known=known), f"order long, at binary, of binary, {', '.join(f'{n} int' for n in NAMES)}")
    got = [(*r,) for r in packed.collect()]  # bounded by MAX_LABELLED and CANDIDATES
    got.sort()
    presence = _Presence(known, [np.frombuffer(r[1], _AT) for r in got], [np.frombuffer(r[2], _OF) for r in got])
    y = np.array([r[3:] for r in got], np.int64).reshape(len(got), len(NAMES))
    del got
    return Chain(presence, y)


class _Known(dict):
    """Word → those of its hashes that the chain knows; bounded."""

    def __init__(self, known):
        super().__init__()
        self.of = known

    def __missing__(self, word: str):
        got = tuple(h for h in forms(word) if h in self.of)
        if len(word) <= LONGEST:
            if len(self) >= MEMORY:
                self.clear()
            self[word] = got
        return got


def _probabilities(texts, chain, known):
    none = chain.judge({})
    for t in texts:
        words = word_hashes(t.as_py(), known)
        yield chain.judge(words) if words else none


def _judge(batches, chain, reject_from):
    known = _Known(chain.known)
    for batch in batches:
        p = np.array(list(_probabilities(batch.column(1), chain, known))).reshape(-1, len(NAMES))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, k]) for k in range(len(NAMES))), pa.array(p[:, -1] >= reject_from)], ["doc_id", *(f"p_{n}" for n in NAMES), "toxic"])


def judge(docs: DataFrame, chain: Chain, reject_from: float = REJECT_FROM) -> DataFrame:
    """``(doc_id, p_<category>..., toxic)``, one row per row of ``docs``."""
    schema = f"doc_id long, {', '.join(f'p_{n} double' for n in NAMES)}, toxic boolean"
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_judge, chain=chain, reject_from=reject_from), schema)


def _select(batches, chain, reject_from, text):
    known = _Known(chain.known)
    for batch in batches:
        yield batch.filter(pa.array([p[-1] < reject_from for p in _probabilities(batch.column(text), chain, known)], pa.bool_()))


def select(docs: DataFrame, chain: Chain, reject_from: float = REJECT_FROM) -> DataFrame:
    """The documents that are not rejected, all columns as they are."""
    return small_batches(docs).mapInArrow(partial(_select, chain=chain, reject_from=reject_from, text=docs.columns.index("text")), docs.schema)
