"""Quality rules against a plain computation and against the SQL twin."""

import hashlib
import math
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from shelfmark.llm.oracles import SQL
from shelfmark.llm.quality_rules import PLACES, _end, base_rules, place_counts, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def number(word):
    return int(hashlib.md5(word.encode()).hexdigest()[:15], 16)


def end(x):
    return (ord(x[-3:][0]) * 7919 + ord(x[-2:][0]) * 6425 + ord(x[-1]) * 5373) % PLACES


def places(w):
    h = [number(x) for x in w]
    pairs = [((a % 2**32) * 31 + b % 2**32) % PLACES for a, b in zip(h, h[1:])]
    return [x % PLACES for x in h] + pairs + [end(x) for x in w]


def base(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(windows)
    repeated = len({i + d for i, x in enumerate(windows) if n[x] > 1 for d in range(5)})
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 10 or 100 * repeated > 20 * len(w)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), repeated, failed


def expected(rows, labels):
    good = {d for d, q in labels if q == 1 and d is not None}
    r, t = Counter(), Counter()
    for d, text in rows:
        found = places(WORD.findall(text or ""))
        r.update(found)
        if d in good:
            t.update(found)
    of_t, of_r = t.total() + PLACES, r.total() + PLACES
    weight = {p: round((math.log((t[p] + 1) / of_t) - math.log((r[p] + 1) / of_r)) * 1e6) if t else 0 for p in r}
    out = []
    for d, text in rows:
        found = places(WORD.findall(text or ""))
        total = sum(weight[p] for p in found)
        failed = base(text)[5]
        out.append((d, *base(text), total / (len(found) * 1e6) if found else 0.0, not failed and total >= -150_000 * len(found)))
    return out


def check(df, labels, rows, known):
    got = [tuple(r) for r in quality_rules(df, labels).collect()]
    key = lambda r: tuple(map(str, r[:7]))
    for g, w in zip(sorted(got, key=key), sorted(expected(rows, known), key=key), strict=True):
        assert g[:7] == w[:7] and g[8] == w[8]
        assert g[7] == pytest.approx(w[7], abs=1e-9)


def test_documents(spark):
    folder = "/root/testdata/sf0.001"
    df, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    check(df, labels, [(r.doc_id, r.text) for r in df.collect()], [(r.doc_id, r.quality) for r in labels.collect()])


ROWS = [
    (1, None), (2, ""), (3, " \n\t"), (None, "a b c d e f g h i j k"), (4, "one two"), (4, "one two"),
    (5, "a b c d e x a b c d e y z z z"), (6, "x\nx\n\nx \ny\n|#"), (7, "ab " * 20_000), (8, "é 　ü\x85x " * 7 + "𝄞𝄞𝄞𝄞"),
    (9, " ".join(f"w{i}" for i in range(30_000))), (10, "the cat sat on the mat and it was a good day for a cat"),
]


def test_edges(spark):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in ROWS], "doc_id long, text string, n_words int, _m string")
    known = [(10, 1), (10, 0), (None, 1), (9, None), (77, 1)]
    labels = spark.createDataFrame(known, "doc_id long, quality int")
    check(df, labels, ROWS, known)
    check(df, labels.where("quality = 5"), ROWS, [])
    assert quality_rules(df.where("doc_id > 99"), labels).count() == 0


def test_sql_on_edges(spark, tmp_path):
    con = duckdb.connect()
    df = spark.createDataFrame([r for r in ROWS if r[0]], "doc_id long, text string")
    labels = spark.createDataFrame([(10, 1), (4, 0)], "doc_id long, quality int")
    for name, table in (("documents", df), ("labels", labels)):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    out = quality_rules(df, labels)
    want = con.execute(SQL["op2_quality_rules"])
    assert [d[0] for d in want.description] == out.columns
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in out.collect())


def test_ends_of_words_without_a_lambda(spark):
    words = ["a", "ab", "abc", "abcd", "é", "xé\u3000", "𝄞𝄞𝄞𝄞", "z𝄞"]
    found = spark.createDataFrame([(w,) for w in words], "w string").select("w", _end(F.col("w")).alias("end"))
    assert {r.w: r.end for r in found.collect()} == {w: end(w) for w in words}
    assert "lambda" not in found._jdf.queryExecution().analyzed().toString()


def test_places_are_counted_without_a_lambda(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").localCheckpoint()
    trusted = spark.createDataFrame([(4,), (10,), (77,)], "_id long")
    base = base_rules(df).localCheckpoint()
    counts = place_counts(base, trusted)
    r, t = Counter(), Counter()
    for d, text in ROWS:
        found = places(WORD.findall(text or ""))
        r.update(found)
        t.update(found if d in (4, 10, 77) else ())
    assert {x.place: (x.r, x.t) for x in counts.collect()} == {p: (n, t[p]) for p, n in r.items()}
    assert "lambda" not in counts._jdf.queryExecution().analyzed().toString()
