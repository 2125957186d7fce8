"""Spelling variants: near pairs and whole results against plain computations."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm.queries import QUERIES
from shelfmark.llm.spelling import near_pairs, spelling_variants


def counted(rows):
    """(word, n) occurrence by occurrence."""
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            total[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    """Rows of the result; near words by the strings that one letter taken out leaves."""
    left = defaultdict(set)
    for w in words:
        left[w].add(w)
        for i in range(len(w)):
            left[w[:i] + w[i + 1 :]].add(w)
    found = defaultdict(set)
    for group in left.values():
        for a in group:
            found[a] |= {b for b in group if b > a and near(a, b)}
    both = defaultdict(set)
    for a, some in found.items():
        for b in some:
            both[a].add(b)
            both[b].add(a)
    form = {}
    for w, n in words.items():
        best = min(both[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    root = lambda w: w if form[w] is None else root(form[w])
    return {(w, form[w], root(w), n, len(both[w]), None if form[w] is None else words[form[w]]) for w, n in words.items()}


def result(df, **options):
    out = [tuple(r) for r in spelling_variants(df, **options).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(out) == len(set(out))
    return set(out)


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text(alphabet="abÀÿ", min_size=2, max_size=5), max_size=40))
def test_near_pairs(words):
    """One bucket that holds the whole words: shorter ones of each length against their like and the next longer."""
    for size in range(2, 6):
        own = sorted(w for w in words if len(w) in (size, size + 1))
        codes = np.array(own, f"<U{size + 1}").view("<u4").reshape(len(own), -1) if own else np.zeros((0, size + 1), "<u4")
        if not own:
            continue
        long = np.array([len(w) > size for w in own])
        yes = np.ones(len(own), bool)
        i, j = near_pairs(codes, np.zeros(len(own)), long, yes)
        got = sorted(tuple(sorted((own[a], own[b]))) for a, b in zip(i.tolist(), j.tolist()))
        want = sorted((a, b) for a in own for b in own if a < b and min(len(a), len(b)) == size and near(a, b))
        assert got == want


def rows():
    base = "colour color colours colouur coulor aaaaa aaaaaa aaaaaaa aaaaab Ünicode ünicode Unicode naïves naives naivés word".split()
    texts = [" ".join([w] * (2 + 3 * k * k)) for k, w in enumerate(base)]
    texts += ["x" * 5000 + " " + "x" * 2500 + "y" + "x" * 2499 + " " + "x" * 5001, "", None, "a1b2c3", "éÀÿ×÷ " * 4, "ab-cdefg,hijkl"] * 3
    texts += ["abcdee " * 4, "abcdef " * 9, "abcdff " * 20]
    return [*enumerate(texts), (None, "colour " * 500), (3, "center centre " * 40), (3, "center centre " * 40)]


@pytest.mark.parametrize("bucket", [4096, 1])
def test_rows(spark, bucket):
    df = spark.createDataFrame([(*r, 1) for r in rows()], "doc_id long, text string, n int")
    got = result(df, bucket=bucket)
    assert got == brute(counted(rows()))
    assert ("abcdee", "abcdef", "abcdff") in {r[:3] for r in got} and any(len(r[0]) >= 5000 and r[4] == 2 for r in got)


def test_hot_bucket(spark):
    """A third of all words share their beginning and end; every one has many near words."""
    rng = np.random.default_rng(5)
    hot = ["intern" + "".join(rng.choice(list("abcd"), 4)) + "ational" for _ in range(900)]
    cold = ["".join(rng.choice(list("aeiourst"), int(rng.integers(5, 9)))) for _ in range(1800)]
    data = [(i, " ".join([w] * int(rng.integers(3, 60)))) for i, w in enumerate([*hot, *cold])]
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = brute(counted(data))
    assert result(df) == want
    assert result(df, bucket=50) == want


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    out = spelling_variants(df)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"] and out.count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = {tuple(r) for r in QUERIES["op13_spelling_variants"](spark, folder).collect()}
    want = brute(counted(docs))
    assert len(want) > 1000 and got == want
