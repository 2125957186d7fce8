"""Quality classifier: naive Bayes support vectors over n-gram indicators."""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import collect_features, labelled_sample, rows_of, score_texts, sigmoid, sums

#: Features are n-grams hashed into this many places.
PLACES = 1 << 20
PER_CLASS = 6000
_ALPHABET = bytes(
    97 if 97 <= b < 123 or b > 127 else 65 if 65 <= b < 91 else 48 if 48 <= b < 58 else 32 if b in b" \t\n\r\v\f" else b
    for b in range(256)
)


def _mix(*parts: np.ndarray) -> np.ndarray:
    """One number for each tuple of numbers."""
    out = np.uint64(len(parts) * 0x9E3779B97F4A7C15 % (1 << 64))
    for p in parts:
        out = (out ^ p) * np.uint64(0xFF51AFD7ED558CCD)
        out = out ^ (out >> np.uint64(32))
    return out


def ngrams(data: bytes) -> np.ndarray:
    """Places of the n-gram indicators of a text, each once.

    Word n-grams of one and two lower-case words, and n-grams of one to three word
    shapes. The shape of a word has one character for each run of lower-case letters,
    capitals, digits or one repeated sign, and tells whether the word before was the
    same; so signs, capitals and repetition are seen in words never met before.
    """
    words = data.lower().split()
    if not words:
        return np.empty(0, np.int32)
    kinds = np.frombuffer(data.translate(_ALPHABET), np.uint8)
    keep = np.ones(len(kinds), bool)
    keep[1:] = kinds[1:] != kinds[:-1]
    shapes = kinds[keep].tobytes().split()
    crc = zlib.crc32
    w = np.array([crc(x) for x in words], np.uint64)
    s = np.array([crc(x, 1) for x in shapes], np.uint64) << np.uint64(1)
    s[1:] |= w[1:] == w[:-1]
    found = [_mix(w), _mix(w[:-1], w[1:]), _mix(s), _mix(s[:-1], s[1:]), _mix(s[:-2], s[1:-1], s[2:])]
    return np.unique((np.concatenate(found) % np.uint64(PLACES)).astype(np.int32))


@dataclass
class Model:
    """Weight of every place, and the slope and offset that turn a margin into a probability."""

    weight: np.ndarray
    slope: float
    offset: float
    #: Score of every text if there was nothing to learn from.
    only: float | None = None

    def margins(self, docs: list[np.ndarray]) -> np.ndarray:
        at, start = rows_of(docs)
        return sums(self.weight[at], start) / np.sqrt(np.maximum(1, np.diff(start)))

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        if self.only is not None:
            return np.full(len(docs), self.only)
        return sigmoid(self.slope * self.margins(docs) + self.offset)


def log_count_ratio(docs: list[np.ndarray], label: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """log of the smoothed share of a feature among those of class 1, over that of class 0."""
    counts = []
    for value in (1, 0):
        c = np.full(PLACES, alpha)
        for d, y in zip(docs, label):
            if y == value:
                c[d] += 1  # a document has each place once
        c /= c.sum()
        counts.append(np.log(c, out=c))
    return counts[0] - counts[1]


def dual_coordinate_descent(
    docs: list[np.ndarray], ratio: np.ndarray, label: np.ndarray, c: np.ndarray, epochs: int, seed: int = 0
) -> np.ndarray:
    """Weights (in units of the scaled features) of a linear hinge-loss model with squared norm penalty.

    One dual variable per document, in [0, c of the document], is moved to its optimum
    in turn; the weights follow. Scaled features are made one document at a time, as
    those of all would be twice the size of the sample.
    """
    rng = np.random.default_rng(seed)

    def scaled(d: np.ndarray) -> np.ndarray:
        return ratio[d] / np.sqrt(max(1, len(d)))

    norm = np.array([v @ v for v in map(scaled, docs)])
    sign = np.where(label == 1, 1.0, -1.0)
    alpha, w = np.zeros(len(docs)), np.zeros(PLACES)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(docs)):
            if not norm[i]:
                continue
            x = scaled(docs[i])
            gradient = sign[i] * (w[docs[i]] @ x) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), c[i])
            if new != alpha[i]:
                w[docs[i]] += (new - alpha[i]) * sign[i] * x
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3 * c.max():
            break
    return w


def fit(sample: list[tuple[int, np.ndarray]], c: float = 1.0, epochs: int = 12) -> Model:
    """NBSVM on (label, features); every fifth document is left for turning margins into probabilities."""
    label = np.array([y for y, _ in sample], int)
    docs = [d for _, d in sample]
    if len(set(label.tolist())) < 2:
        return Model(np.zeros(1), 0, 0, float(label[0]) if len(label) else 1.0)
    rest = np.arange(len(docs)) % 5 == 4
    if len(set(label[~rest].tolist())) < 2:
        rest[:] = False
    some = [d for d, r in zip(docs, rest) if not r]
    y = label[~rest]
    ratio = log_count_ratio(some, y)
    share = y.mean()
    weight = dual_coordinate_descent(some, ratio, y, c * np.where(y == 1, 0.5 / share, 0.5 / (1 - share)), epochs)
    model = Model((weight * ratio).astype(np.float32), 1.0, 0.0)
    if rest.any():
        m, t = model.margins([d for d, r in zip(docs, rest) if r]), label[rest]
    else:
        m, t = model.margins(some), y
    model.slope, model.offset = platt(m, t)
    return model


def platt(margin: np.ndarray, label: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and offset of the logistic curve through (margin, label), by Newton steps with a weak prior."""
    n1, n0 = (label == 1).sum(), (label == 0).sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones(len(margin))], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(steps):
        p = sigmoid(x @ theta)
        gradient = x.T @ (p - target) + 1e-3 * (theta - [1.0, 0.0])
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        theta -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(theta[0]), 1e-3), float(theta[1])


def quality(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    label: str = "quality",
    threshold: float = 0.7,
    per_class: int = PER_CLASS,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """(id, or the columns ``keep``, score, predicted) of every row: how likely label 1 is, from the text alone.

    The model is fitted on the driver from at most ``per_class`` documents of each
    class whose label rows satisfy ``train``; texts are scored whole, on the executors.
    Null and empty texts have no n-grams and get the score of margin 0. Without labels
    every score is 1, with labels of one class it is that class. Repeated rows and null
    ids are scored like others; an empty table gives no rows; other columns are left.
    """
    sample = labelled_sample(docs, labels, label, train, per_class, id_col, text_col)
    model = fit(collect_features(sample, ngrams))
    scored = score_texts(docs, lambda: lambda batch: model.score([ngrams(t) for t in batch]), text_col, keep or [id_col])
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
