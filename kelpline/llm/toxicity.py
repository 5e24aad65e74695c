"""Toxicity by cumulative-link ordinal regression over sparse text features.

P(grade <= k) = sigmoid(theta_k - w.x): all thresholds share the weights w, and theta is increasing. x holds
log(1 + count) of the terms that the labelled sample ties to toxicity. Output is the expected grade.

Grades come from the labels and from how much of a text supports them: 0 not labelled toxic; else 1, 2 or 3 as the
text has under GRADE_CUTS[0], under GRADE_CUTS[1] or more occurrences of toxic terms. A toxic label that no term supports
(labels are noisy) is thus the mildest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm.store import through, tidy
from kelpline.llm.words import HashIndex, blocks, hash_words, mix, shingle_sets, terms_of

#: Labelled documents that the sample is drawn for, by hash of doc_id, with one text each.
TRAIN_ROWS = 8000
#: Terms kept, texts that a term must be in, its least share of toxic ones among them, and how many terms may pass by chance.
TERMS, LEAST_TEXTS, LEAST_SHARE, CHANCE = 2048, 4, 0.5, 0.01
GRADE_CUTS = (4, 8)
RIDGE, STEPS = 0.05, 400

SCORED = "doc_id long, severity double, p_toxic double, grade int, toxic boolean"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class OrdinalModel:
    """Terms (64-bit hashes, sorted), their weights, and increasing thresholds that share them."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, theta: np.ndarray, cut: float = 0.5):
        self.cut, self.theta, self.weights, self.index = cut, theta, weights, HashIndex(terms)

    def score(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(expected grade, P(grade >= 1), likeliest grade) of each text."""
        words = [terms_of(t) for t in texts]
        ends = np.cumsum([len(w) for w in words])
        at, term = self.index.find(hash_words([w for ws in words for w in ws]))
        eta = np.zeros(len(texts))
        if len(at):
            text = np.searchsorted(ends, at, side="right")
            pairs, counts = np.unique(text * len(self.index.keys) + term, return_counts=True)
            eta += np.bincount(pairs // len(self.index.keys), np.log1p(counts) * self.weights[pairs % len(self.index.keys)], len(texts))
        above = 1 - _sigmoid(self.theta[None, :] - eta[:, None])  # P(grade > k)
        each = np.diff(np.hstack([np.zeros((len(texts), 1)), 1 - above, np.ones((len(texts), 1))]), axis=1)
        return above.sum(axis=1), above[:, 0] if len(self.theta) else np.zeros(len(texts)), each.argmax(axis=1)


def families(texts: list[bytes]) -> np.ndarray:
    """A number for each text; texts that share one of two min-hashes of their shingles have the same."""
    root = list(range(len(texts)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first: dict[tuple[int, int], int] = {}
    for at in range(0, len(texts), 256):
        for i, s in enumerate(shingle_sets(texts[at : at + 256]), at):
            for k, seed in enumerate((0, 0xA5A5A5A5A5A5A5A5)) if len(s) else ():
                j = first.setdefault((k, int(mix(s ^ np.uint64(seed)).min())), i)
                root[find(i)] = find(j)
    return np.unique([find(i) for i in range(len(texts))], return_inverse=True)[1]


def fit(rows: list[tuple[bytes | None, int]]) -> OrdinalModel:
    """(text, toxic) rows -> model. Repeated texts count once. Without both labels nothing is toxic."""
    rows = sorted({(t, y) for t, y in rows if t and y is not None})
    toxic = np.array([y != 0 for _, y in rows], bool)
    if not toxic.any() or toxic.all():
        return OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.array([40.0]))
    bags = [np.unique(hash_words(terms_of(t)), return_counts=True) for t, _ in rows]
    doc = np.repeat(np.arange(len(rows)), [len(b[0]) for b in bags])
    word, count = (np.concatenate([b[k] for b in bags]) for k in (0, 1))
    # Near copies of a text are one witness: what only they have in common says nothing about toxicity.
    family = families([t for t, _ in rows])
    weight = 1 / np.bincount(family)[family]
    sides = []
    for side in (True, False):
        own = toxic[doc] == side
        _, one = np.unique(mix(word[own] ^ mix(family[doc[own]].astype(np.uint64))), return_index=True)
        sides.append(np.unique(word[own][one], return_counts=True))
    # Terms tied to toxicity more often than chance would: a share among families, and a bound on the
    # chance of so many toxic ones at the base rate (Chernoff), over all terms tried. How common the term is says nothing.
    base = (weight * toxic).sum() / weight.sum()
    (inside, a), (without, c) = sides
    at = np.minimum(np.searchsorted(without, inside), max(0, len(without) - 1))
    n = a + np.where(without[at] == inside, c[at], 0)
    score = (a - n * base) / np.sqrt(n * base * (1 - base))
    fit_ = (n >= LEAST_TEXTS) & (a / n >= LEAST_SHARE)
    share = a / n
    surprise = n * (share * np.log(share / base) + (1 - share) * np.log(np.maximum(1 - share, 1e-12) / (1 - base)))
    fit_ &= (share > base) & (surprise >= np.log(max(1, (n >= LEAST_TEXTS).sum()) / CHANCE))
    terms = np.sort(inside[fit_][np.lexsort((inside[fit_], -score[fit_]))][:TERMS])
    place = np.minimum(np.searchsorted(terms, word), max(0, len(terms) - 1))
    own = terms[place] == word if len(terms) else np.zeros(len(word), bool)
    row, col, x = doc[own], place[own], np.log1p(count[own])
    support = np.bincount(row, count[own], len(rows))
    grade = np.where(toxic, 1 + np.searchsorted(GRADE_CUTS, support, side="right"), 0)
    n_grades = int(grade.max()) + 1

    # theta_0, then gaps by their logs, so that thresholds stay in order; Adam on the mean log loss plus ridge.
    share = np.array([(grade <= k).mean() for k in range(n_grades - 1)])
    start = np.log(np.clip(share, 1e-4, 1 - 1e-4) / (1 - np.clip(share, 1e-4, 1 - 1e-4)))
    free = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 0.05))])
    params = np.concatenate([np.zeros(len(terms)), free])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, STEPS + 1):
        w, free = params[: len(terms)], params[len(terms) :]
        theta = np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])
        eta = np.bincount(row, x * w[col], len(rows)) if len(terms) else np.zeros(len(rows))
        upper = np.where(grade < n_grades - 1, _sigmoid(np.append(theta, 0)[np.minimum(grade, n_grades - 1)] - eta), 1.0)
        lower = np.where(grade > 0, _sigmoid(theta[np.maximum(grade - 1, 0)] - eta), 0.0)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = weight * upper * (1 - upper) / p, weight * lower * (1 - lower) / p
        g_eta = (du - dl) / len(rows)  # of the loss -log p
        g_theta = np.zeros(n_grades - 1)
        np.add.at(g_theta, np.minimum(grade, n_grades - 2), np.where(grade < n_grades - 1, -du, 0) / len(rows))
        np.add.at(g_theta, np.maximum(grade - 1, 0), np.where(grade > 0, dl, 0) / len(rows))
        after = np.cumsum(g_theta[::-1])[::-1]
        grad = np.concatenate([np.bincount(col, x * g_eta[row], len(terms)) + RIDGE * w / len(rows), after[:1], after[1:] * np.exp(free[1:])])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    free = params[len(terms) :]
    return OrdinalModel(terms, params[: len(terms)], np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))]))


def _texts(docs: DataFrame, *columns) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), *columns)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> OrdinalModel:
    """Fit on about `rows` labelled documents, chosen by hash, so that reruns agree. One task fits the
    sample, whose size is bounded; the driver gets the model alone.

    Of rows that share a doc_id the least text is the document's.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).dropna()
    share = min(1.0, rows / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    found = _texts(docs).join(chosen, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("text", "y")
    model = found.repartition(1).mapInArrow(_fit, "terms binary, weights binary, theta binary").first()
    if model is None:
        return fit([])
    return OrdinalModel(np.frombuffer(bytes(model.terms), np.uint64), np.frombuffer(bytes(model.weights)), np.frombuffer(bytes(model.theta)))


@tidy
def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole sample (text, y) -> one row with the model's arrays."""
    rows = []
    for batch in batches:
        rows += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
    model = fit(rows)
    yield pa.record_batch([pa.array([x.tobytes()], pa.binary()) for x in (model.index.keys, model.weights, model.theta)], names=["terms", "weights", "theta"])


def _score(model: OrdinalModel):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                severity, p, grade = model.score(texts)
                yield pa.record_batch(
                    [pa.array(ids, pa.int64()), pa.array(np.round(severity, 6)), pa.array(np.round(p, 6)), pa.array(grade, pa.int32()), pa.array(p >= model.cut)],
                    names=["doc_id", "severity", "p_toxic", "grade", "toxic"],
                )

    return run


def score_toxicity(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, severity (expected grade, 0 to 3), p_toxic, grade (likeliest), toxic.

    Whole texts are read. Defined cases: a null or empty text scores as one without known terms; rows that share a
    doc_id are scored each; a null doc_id is kept as null; other columns are ignored.
    """
    return _texts(docs).mapInArrow(_score(model), SCORED)


def keep_civil(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """The rows of docs that the model doesn't call toxic, with all their columns, in one pass without a shuffle."""
    place = docs.columns.index("text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).cast(pa.binary()).to_pylist()
            p = np.concatenate([model.score(part)[1] for _, part in blocks(texts, texts)]) if texts else np.zeros(0)
            yield batch.filter(pa.array(p < model.cut))

    return through(docs, run)
