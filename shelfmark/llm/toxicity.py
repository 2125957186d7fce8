"""Toxicity: non-negative positive-unlabelled learning of a linear classifier in numpy."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import collect_features, labelled_sample, rows_of, score_texts, sigmoid, sums, text_sample

PER_CLASS = 5000
#: Words and beginnings are hashed into this many places, of which each has LEVELS numbers.
PLACES = 1 << 28
_LETTERS = bytes(
    b + 32 if 65 <= b < 91 else b if 97 <= b < 123 or 48 <= b < 58 or b > 127 or b == 39 else 32 for b in range(256)
)
MARKS = 8
LEVELS = 4


def _words(data: bytes) -> list[bytes]:
    """The words of a text in lower case, cut at blanks and ASCII signs."""
    return data.translate(_LETTERS).split()


def word_places(word: bytes) -> list[int]:
    """Places of a word: of itself, and of its beginnings of 3 to 10 bytes.

    Beginnings show a stem in inflected forms that no training text has.
    """
    crc = zlib.crc32
    return [crc(word + b"$") % PLACES] + [crc(word[:k]) % PLACES for k in range(3, min(10, len(word)) + 1)]


def _levels(place: int, n: int) -> list[int]:
    """Numbers that tell of at least 1, 2, 4 and 8 words with a place, as far as there are ``n``."""
    return [place + k * PLACES for k in range(min(LEVELS, n.bit_length()))]


def features(data: bytes) -> np.ndarray:
    """Places of all words and of their number, each once; before them, as negative numbers, marks.

    The marks of a text are the smallest hashes of its runs of five words: copies share them.
    """
    words = _words(data)
    joined = {zlib.crc32(b" ".join(words[i : i + 5])) >> 2 for i in range(max(1, len(words) - 4))}
    marks = [-1 - m for m in sorted(joined)[:MARKS]] if words else []
    counts: Counter[int] = Counter()
    for w, n in Counter(words).items():
        for p in word_places(w):
            counts[p] += n
    places = {q for p, n in counts.items() for q in _levels(p, n)}
    return np.array(marks[::-1] + sorted(places), np.int32)


@dataclass
class Model:
    """Weights of the chosen places and the bias."""

    weight: dict[int, float]
    bias: float

    def scorer(self, cached: int = 200_000) -> Callable[[list[bytes]], np.ndarray]:
        """A function from texts to scores; it keeps the chosen places of words met before."""
        known: dict[bytes, tuple[int, ...]] = {}
        weight = self.weight
        chosen = {q % PLACES for q in weight}

        def margin(text: bytes) -> float:
            found: dict[int, int] = {}
            for w in _words(text):
                places = known.get(w)
                if places is None:
                    if len(known) >= cached:
                        known.clear()
                    places = known[w] = tuple(p for p in word_places(w) if p in chosen)
                for p in places:
                    found[p] = found.get(p, 0) + 1
            levels = {q for p, n in found.items() for q in _levels(p, n)}
            return sum(weight[q] for q in sorted(levels) if q in weight)

        return lambda batch: sigmoid(np.array([margin(t) for t in batch], float) + self.bias)


def without_copies(docs: list[np.ndarray]) -> list[int]:
    """Which documents do not share more than half of their marks with one earlier document that stays.

    Copies of one document in the sample would make its rare words look like evidence.
    Documents that only have a passage in common all stay.
    """
    owners: dict[int, list[int]] = {}
    first = []
    for i, d in enumerate(docs):
        marks = d[d < 0].tolist()
        shared = Counter(j for m in marks for j in owners.get(m, ()))
        if not shared or 2 * max(shared.values()) <= len(marks):
            first.append(i)
            for m in marks:
                owners.setdefault(m, []).append(i)
    return first


def vocabulary(positive: list[np.ndarray], unlabelled: list[np.ndarray], z: float = 3.0, size: int = 1 << 14) -> np.ndarray:
    """Numbers that more positive than unlabelled documents have, by ``z`` standard errors; at most ``size``.

    Those of under three positive documents are left.
    """
    n1, n0 = len(positive), len(unlabelled)
    all_ = rows_of(positive)[0]
    all_.sort()
    found = np.unique(all_[2:][all_[2:] == all_[:-2]])
    if not len(found):
        return found
    a = np.searchsorted(all_, found, "right") - np.searchsorted(all_, found)
    del all_
    b = np.zeros(len(found), np.int64)
    for d in unlabelled:
        at = np.searchsorted(found, d)
        at[at == len(found)] = 0
        b[at[found[at] == d]] += 1
    p = (a + b + 1) / (n1 + n0 + 2)
    lead = (a / n1 - b / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    best = np.argsort(-lead, kind="stable")[:size]
    return np.sort(found[best[lead[best] >= z]])


def nnpu(
    positive: list[np.ndarray],
    unlabelled: list[np.ndarray],
    size: int,
    prior: float,
    epochs: int = 300,
    rate: float = 0.1,
    decay: float = 1e-4,
    seed: int = 0,
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative positive-unlabelled risk.

    With the sigmoid loss l, class prior p and positive and unlabelled samples P and
    U, the risk is ``p * mean_P l(+) + max(0, mean_U l(-) - p * mean_P l(-))``. When the
    part in brackets is negative, its gradient is followed upwards instead, which keeps
    the classifier from fitting the positives hidden in U. Steps are Adam steps over the
    whole sample.
    """
    at_p, start_p = rows_of(positive)
    at_u, start_u = rows_of(unlabelled)
    len_p, len_u = np.diff(start_p), np.diff(start_u)
    theta = np.zeros(size + 1)
    theta[-1] = -1.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)

    def gradient(slope: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        g = np.bincount(at, np.repeat(slope, lengths), minlength=size + 1)
        g[-1] = slope.sum()
        return g

    for t in range(1, epochs + 1):
        fp = sigmoid(sums(theta[at_p], start_p) + theta[-1])  # loss as negative; 1 - fp as positive
        fu = sigmoid(sums(theta[at_u], start_u) + theta[-1])
        slope_p, slope_u = fp * (1 - fp) / len(fp), fu * (1 - fu) / len(fu)
        negative = fu.mean() - prior * fp.mean()
        g_negative = gradient(slope_u, at_u, len_u) - prior * gradient(slope_p, at_p, len_p)
        if negative >= 0:
            g = g_negative - prior * gradient(slope_p, at_p, len_p)
        else:
            g = -g_negative
        g[:-1] += decay * theta[:-1]
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float | None) -> Model:
    """A model from confirmed positives and unlabelled text, of which ``prior`` is the share of positives."""
    if not positive or prior is None:
        return Model({}, -40.0)
    # numbers are in order, marks first: what follows them is a view, not a copy
    positive, unlabelled = ([docs[i][np.searchsorted(docs[i], 0) :] for i in without_copies(docs)] for docs in (positive, unlabelled))
    places = vocabulary(positive, unlabelled)
    if not len(places):
        return Model({}, float(np.log(min(prior, 0.49) / (1 - min(prior, 0.49)))))

    def keep(d: np.ndarray) -> np.ndarray:
        at = np.searchsorted(places, d)
        at[at == len(places)] = 0
        return at[places[at] == d]

    weight, bias = nnpu([keep(d) for d in positive], [keep(d) for d in unlabelled], len(places), prior)
    return Model(dict(zip(places.tolist(), weight.tolist())), bias)


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    label: str = "toxic",
    threshold: float = 0.5,
    per_class: int = PER_CLASS,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """(id, or the columns ``keep``, score, predicted) of every row: how likely a text is toxic, from the text alone.

    The confirmed examples are at most ``per_class`` documents labelled 1 for which
    ``train`` holds. The unlabelled text is that of at most as many different texts of
    the whole table, whether labelled or not; no label of theirs is used. The share of
    the class in it is taken to be that in all label rows of ``train``. The classifier is
    fitted on the driver; texts are scored whole, on the executors. Null and empty texts
    get the score of a text without any known word. Without a confirmed example every
    score is near 0; without any word that tells the classes apart it is the share of the
    class, but below 0.5. Repeated rows and null ids are scored like others; an empty table
    gives no rows; other columns are left.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.coalesce(train, F.lit(False)))
    prior = known.agg(F.avg(label)).first()[0]
    confirmed = labelled_sample(docs, labels, label, train, per_class, id_col, text_col, values=(1,))
    unlabelled = text_sample(docs, per_class, text_col).withColumn("_label", F.lit(0))
    positive, rest = ([d for _, d in collect_features(sample, features)] for sample in (confirmed, unlabelled))
    model = fit(positive, rest, prior)
    scored = score_texts(docs, model.scorer, text_col, keep or [id_col])
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
