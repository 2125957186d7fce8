"""Toxicity and quality: held-out accuracy, edge rows, and the parts of the training."""

import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import nbsvm, toxicity
from shelfmark.llm.labelled import fold, labelled_sample, sigmoid, text_sample
from shelfmark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.1"


@pytest.mark.parametrize(
    "name, label, parts, rest, least", [("op3_toxicity", "toxic", 5, 0, 0.97), ("op6_quality_classifier", "quality", 4, 2, 0.99)]
)
def test_held_out(spark, name, label, parts, rest, least):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    out = QUERIES[name](spark, FOLDER)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == rest) for r in rows)
    cut = 0.5 if label == "toxic" else 0.7
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= cut) for r in rows)
    seen = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in seen]) >= least
    hits = sum(p for p, y in seen if y == 1)
    assert hits / sum(y for _, y in seen) > 0.85 and hits / sum(p for p, _ in seen) > 0.95
    again = {r.doc_id: r.score for r in QUERIES[name](spark, FOLDER).collect()}
    assert all(again[r.doc_id] == r.score for r in rows)


@pytest.mark.parametrize("run, label, alone", [(toxicity.toxicity, "toxic", 0), (nbsvm.quality, "quality", 1)])
def test_edges(spark, run, label, alone):
    rng = np.random.default_rng(3)
    stock = [f"{a}{b}" for a in ("ba", "do", "mi", "ru", "te", "so") for b in ("n", "rt", "lly", "x", "mme", "st", "v")]
    good = "the quick brown fox"

    def made(i):
        w = rng.choice(stock, 30).tolist()
        return " ".join([x.upper() + "!!" for x in w] + ["idiot!!", "scum!!"] if i % 2 else w)

    rows = [(i, made(i)) for i in range(200)]
    rows += [(None, good), (1000, None), (1001, ""), (1002, " \n"), (1002, " \n"), (1003, "é " * 40_000)]
    df = spark.createDataFrame([(d, t, 0.5, 9, "x") for d, t in rows], "doc_id long, text string, score double, _id int, `_0` string")
    known = [(i, i % 2 if label == "toxic" else 1 - i % 2) for i in range(150)] + [(None, 1), (3, None), (4, 7), (9999, 1)]
    labels = spark.createDataFrame(known, f"doc_id long, {label} int")
    out = run(df, labels, F.lit(True)).collect()
    assert len(out) == len(rows)
    assert all((r.predicted == 1) == (r.doc_id % 2 == (label == "toxic")) for r in out if r.doc_id is not None and r.doc_id < 200)
    kept = run(df, labels, F.lit(True), keep=df.columns)
    assert set(kept.columns) == {*df.columns, "predicted"} and kept.count() == len(rows)
    nothing = run(df, labels.where("doc_id > 99999"), F.lit(True)).collect()
    assert len(nothing) == len(rows) and {r.predicted for r in nothing} == {alone}
    one = labels.where(F.col(label) == alone)
    assert {r.predicted for r in run(df, one, F.lit(True)).collect()} == {alone}
    assert run(df.where("doc_id < 0"), labels, F.lit(True)).count() == 0


def test_sample(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(100)] + [(5, "again"), (None, "n")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3 == 0) for i in range(120)] + [(1, True)], "doc_id long, y boolean").select("doc_id", F.col("y").cast("int").alias("y"))
    train = fold("doc_id", 4) != 2
    some = labelled_sample(docs, labels, "y", train, 10).collect()
    again = labelled_sample(docs.repartition(7), labels.repartition(3), "y", train, 10).collect()
    assert sorted(some) == sorted(again) and [r["_label"] for r in some].count(1) == 10 and len(some) == 20
    assert all(zlib.crc32(str(r["_id"]).encode()) % 4 != 2 for r in some)


def test_dual_coordinate_descent_reaches_the_optimum():
    """The primal and dual objectives meet."""
    rng = np.random.default_rng(0)
    docs = [np.unique(rng.integers(0, 30, 8)).astype(np.int32) for _ in range(60)]
    y = rng.integers(0, 2, 60)
    ratio = rng.normal(size=nbsvm.PLACES)
    c = np.full(60, 0.5)
    w = nbsvm.dual_coordinate_descent(docs, ratio, y, c, 4000)
    x = np.zeros((60, nbsvm.PLACES))
    for i, d in enumerate(docs):
        x[i, d] = ratio[d] / np.sqrt(len(d))
    sign = np.where(y == 1, 1, -1)
    loss = lambda v: 0.5 * v @ v + (c * np.maximum(0, 1 - sign * (x @ v))).sum()
    assert all(loss(w) <= loss(w + 0.01 * rng.normal(size=w.shape) * (w != 0)) + 1e-6 for _ in range(50))


def test_unlabelled_positives_do_not_count_as_negatives():
    """Half of the positives hide among the unlabelled; words decide."""
    rng = np.random.default_rng(1)
    clean = [np.array([0], np.int64)[:0] for _ in range(300)]
    marked = [np.array([int(rng.integers(0, 3))]) for _ in range(100)]
    weight, bias = toxicity.nnpu(marked[:50], clean + marked[50:], 3, 50 / 350)
    assert (sigmoid(weight + bias) > 0.5).all() and sigmoid(np.array([bias]))[0] < 0.5


def test_risk_falls_as_by_plain_steps():
    """One Adam step from a plain finite-difference gradient of the risk gives the same weights."""
    rng = np.random.default_rng(5)
    docs = [np.unique(rng.integers(0, 6, 4)) for _ in range(40)]
    positive, unlabelled, prior = docs[:10], docs[10:], 0.2

    def score(theta, d):
        return 1 / (1 + np.exp(-(theta[d].sum() + theta[-1])))

    def risk(theta):
        fp, fu = (np.mean([score(theta, d) for d in part]) for part in (positive, unlabelled))
        return prior * (1 - fp) + max(0.0, fu - prior * fp) + 0.5e-4 * (theta[:-1] ** 2).sum()

    theta = np.append(np.zeros(6), -1.0)
    slope = np.array([(risk(theta + e) - risk(theta - e)) / 2e-6 for e in 1e-6 * np.eye(7)])
    plain = theta - 0.1 * slope / (np.abs(slope) + 1e-8)
    weight, bias = toxicity.nnpu(positive, unlabelled, 6, prior, epochs=1)
    assert np.allclose(np.append(weight, bias), plain, atol=1e-4)


def test_shared_passages_are_no_copies():
    marks = lambda *m: np.array([-1 - x for x in sorted(m, reverse=True)] + [3, 7], np.int32)
    one, copy = marks(*range(8)), marks(*range(5), 20, 21, 22)
    passage = [marks(0, 1, *range(100 * i, 100 * i + 6)) for i in range(1, 30)]
    assert toxicity.without_copies([one, copy, one, *passage]) == [0, *range(3, 32)]


def test_texts_for_the_unlabelled_part(spark):
    rows = [(i, f"t{i % 40}", 1) for i in range(200)] + [(None, None, 2), (None, "", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id int")
    everything = text_sample(docs, 1000).collect()
    assert sorted(r._text for r in everything) == sorted({t or "" for _, t, _ in rows})
    some = sorted(r._text for r in text_sample(docs, 10).collect())
    assert len(some) == 10 and some == sorted(r._text for r in text_sample(docs.repartition(5), 10).collect())


def _peak(run):
    """What ``run`` returns, and how many bytes more than before it held at once."""
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_fits_hold_no_copies_of_the_sample():
    rng = np.random.default_rng(5)
    docs = [np.unique(rng.integers(0, nbsvm.PLACES, 2000)).astype(np.int32) for _ in range(1500)]
    label = np.arange(len(docs)) % 2
    sample = sum(d.nbytes for d in docs)
    ratio, held = _peak(lambda: nbsvm.log_count_ratio(docs, label))
    assert held < 4 * 8 * nbsvm.PLACES + sample // 4
    _, held = _peak(lambda: nbsvm.dual_coordinate_descent(docs, ratio, label, np.ones(len(docs)), 1))
    assert held < 8 * nbsvm.PLACES + sample // 2
    marked = [np.concatenate((np.arange(-8 * i - 8, -8 * i, dtype=np.int32), d)) for i, d in enumerate(docs)]
    _, held = _peak(lambda: toxicity.fit(marked[:750], marked[750:], 0.1))
    assert held < 2 * sample


def test_vocabulary_is_that_of_plain_counts():
    rng = np.random.default_rng(6)
    positive = [np.unique(rng.zipf(1.3, 60) % 500).astype(np.int32) for _ in range(80)]
    unlabelled = [np.unique(rng.integers(0, 500, 20)).astype(np.int32) for _ in range(90)]
    a = {x: sum(x in d for d in positive) for x in range(500)}
    b = {x: sum(x in d for d in unlabelled) for x in range(500)}
    share = {x: (a[x] + b[x] + 1) / 172 for x in a}
    lead = {x: (a[x] / 80 - b[x] / 90) / np.sqrt(share[x] * (1 - share[x]) * (1 / 80 + 1 / 90)) for x in a}
    want = [x for x in a if a[x] >= 3 and lead[x] >= 3]
    assert want and toxicity.vocabulary(positive, unlabelled).tolist() == want
