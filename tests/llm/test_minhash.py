"""MinHash fingerprints: a plain computation of every digit, the edited texts, and true likeness."""

import hashlib

import pytest
import xxhash
from pyspark.sql import functions as F

from shelfmark.llm.minhash import BINS, END, _orders, edited_fingerprints, fingerprint, signature


def split(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in text.split(" ") if w]


def chain(*numbers):
    h = 42
    for x in numbers:
        h = xxhash.xxh64_intdigest((x % 2**64).to_bytes(8, "little"), h)
    return h


def shingles(text, n=5):
    w = split(text)
    return [w[i : i + n] for i in range(max(1, len(w) - n + 1))]


def digits(text, orders=_orders(BINS)):
    bins = [None] * BINS
    for s in shingles(text):
        h = chain(*[xxhash.xxh64_intdigest(w.encode(), 42) for w in s])
        h = h - 2**64 if h >> 63 else h
        at = (h >> 56) + BINS // 2
        if h & END != END and (bins[at] is None or h < bins[at]):
            bins[at] = h
    out = ""
    for i in range(BINS):
        v = bins[i] if bins[i] is not None else next(bins[j] for j in orders[i] if bins[j] is not None)
        h = 42
        h = xxhash.xxh64_intdigest((v % 2**64).to_bytes(8, "little"), h)
        h = xxhash.xxh64_intdigest(i.to_bytes(4, "little"), h)
        out += f"{h & 15:x}"
    return out


def estimate(a, b):
    return max(0.0, (sum(x == y for x, y in zip(a, b)) / BINS - 1 / 16) / (15 / 16))


def jaccard(a, b):
    a, b = ({tuple(s) for s in shingles(t)} for t in (a, b))
    return len(a & b) / len(a | b)


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, (d, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        m = len(t) // 3
        edited = t[: len(t) - m] + after[:m]
        own, new, other = digits(t), digits(edited), digits(after)
        out.append((d, len(t), edited, hashlib.sha256(edited.encode()).hexdigest(), own, new, estimate(own, new), estimate(own, other)))
    return out


def check(df, rows, **options):
    got = [tuple(r) for r in edited_fingerprints(df, **options).collect()]
    want = expected(rows)
    key = lambda r: (str(r[0]), r[2], r[7])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:6] == w[:6]
        assert g[6:] == pytest.approx(w[6:])
    return want


@pytest.mark.parametrize("slices", [1, 7, 300])
def test_documents(spark, slices):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = check(df, rows, slices=slices)
    if slices == 1:
        text = dict(rows)
        errors = [abs(w[6] - jaccard(text[w[0]], w[2])) for w in want]
        assert sum(errors) / len(errors) < 0.04
        assert sum(w[7] for w in want) / len(want) < 0.05


def test_edges(spark):
    rows = [(1, None), (4, ""), (4, "a b c d e f g"), (4, "a b c d e f g"), (9, "äöü 　x" * 40), (None, "z z"), (None, None)]
    rows += [(7, "w" + " ww" * 30_000), (-3, "one")]
    df = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id long, text string, signature string, `_next` int")
    for slices in (1, 5):
        check(df, rows, slices=slices)


def test_one_row_and_none(spark):
    df = spark.createDataFrame([(5, "abc def")], "doc_id int, text string")
    check(df, [(5, "abc def")])
    assert edited_fingerprints(df.where("doc_id > 9")).count() == 0


def test_low_bits_are_corrected(spark):
    """One shingle each: copied bins of different texts agree by chance only."""
    df = spark.range(60).select(F.concat(F.lit("word"), "id").alias("t"))
    prints = [r[0] for r in df.select(fingerprint(signature(F.col("t")))).collect()]
    alike = [estimate(a, b) for a in prints for b in prints if a < b]
    assert max(alike) < 0.15 and len(set(prints)) == 60
