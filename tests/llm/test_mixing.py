"""Mixing against a plain computation of targets, and of what the draws must add up to."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm.mixing import draws, mix, splitting_tree, targets


def size(text):
    for c in "\t\n\x0b\x0c\r":
        text = (text or "").replace(c, " ")
    return sum(1 for w in text.split(" ") if w)


def goal(sizes):
    """Targets by raising one common level until all words are shared."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total = sum(sizes.values())
    low, high = 0.0, 1e12
    for _ in range(300):
        level = (low + high) / 2
        if sum(min(3 * sizes[s], level * weight[s]) for s in order) < total:
            low = level
        else:
            high = level
    return {s: min(3 * sizes[s], low * weight[s]) for s in order}


def check(rows, found):
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    want, taken, source = goal(sizes), defaultdict(int), {}
    for d, t, s in rows:
        source[d] = s
    assert sorted((str(r.doc_id), r.size) for r in found) == sorted((str(d), size(t)) for d, t, _ in rows)
    for r in found:
        words = sum(d["words"] for d in r.draws)
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s], abs=1e-3)
        assert words <= 3 * r.size
        taken[s] += words
    return want, taken


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
    found = draws(df, shards=8).collect()
    want, taken = check(rows, found)
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1
    again = draws(df.repartition(5), shards=8).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    parts = [r for r in found for d in r.draws if d["words"] != r.size]
    assert len(parts) <= len(want)
    shares = defaultdict(lambda: np.zeros(8))
    for r in found:
        for d in r.draws:
            shares[r.target][d["shard"]] += d["words"]
    total = sum(shares.values())
    assert total.min() > 0.7 * total.mean()


def test_mixed_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("mix_shard0", F.lit(1))
    drawn = {r.doc_id: sum(d["words"] for d in r.draws) for r in draws(df).collect()}
    out = mix(df).collect()
    got, text = defaultdict(int), {r.doc_id: r.text for r in df.collect()}
    for r in out:
        got[r.doc_id] += size(r.text)
        assert text[r.doc_id].startswith(r.text)
    assert dict(got) == {d: n for d, n in drawn.items() if n or d in got}
    for shard in {r.mix_shard for r in out}:
        places = [r.mix_place for r in out if r.mix_shard == shard]
        assert places == sorted(places)


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x " * 30_000, "b"), (4, " \tone two", "c"), (4, " \tone two", "c")]
    rows += [(None, "three", None), (None, None, None), (7, "four five six", "é")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    want, taken = check(rows, draws(df).collect())
    for s, t in want.items():
        assert abs(taken[s] - t) <= 2
    assert mix(df).count() >= 3
    assert draws(df.where("size > 1")).count() == 0 and mix(df.where("size > 1")).count() == 0
    with pytest.raises(ValueError):
        import shelfmark.llm.mixing as m

        old, m.MAX_SOURCES = m.MAX_SOURCES, 2
        try:
            draws(df)
        finally:
            m.MAX_SOURCES = old


def test_tree():
    quotas = [5, 0, 1000, 37]
    out = splitting_tree(quotas, 7, 3)
    assert out.sum(axis=1).tolist() == quotas
    per = out.sum(axis=0)
    assert per.max() - per.min() <= 3
    many = np.array([splitting_tree([30, 10], 4, s)[0, 0] for s in range(2000)])
    assert many.mean() == pytest.approx(7.5, abs=0.1)
    assert many.var() == pytest.approx(10 * 0.75 * 0.25 * 30 / 39, abs=0.15)


def test_targets():
    assert [s.target for s in targets([("b", 10), ("a", 100), (None, 50)], (1, 2, 3))] == pytest.approx([32.5, 30, 97.5])
