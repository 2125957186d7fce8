"""Decontamination: the automaton against sets of windows, blocks, awkward rows, removal, the SQL twin."""

import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm.decontaminate import Automaton, find_leaks, n_hit, remove_leaks, words
from shelfmark.llm.oracles import SQL
from shelfmark.llm.queries import QUERIES


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, size):
    """(words hit, items) by a set of windows."""
    found = plain_words(text)
    hit, who = set(), set()
    for item, body in items:
        own = plain_words(body)
        n = min(size, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(found) - n + 1 if n else 0):
            if tuple(found[i : i + n]) in windows:
                hit.update(range(i, i + n))
                who.add("" if item is None else str(item))
    return hit, who


@given(st.text(max_size=60))
def test_words(text):
    assert words(text.encode()) == [w.encode() for w in plain_words(text)]


letters = st.lists(st.sampled_from("abc"), max_size=25)


@settings(max_examples=400, deadline=None)
@given(st.lists(letters, max_size=5), letters, st.integers(1, 5))
def test_automaton(lists, tokens, size):
    lists = [(str(i % 4), x) for i, x in enumerate(lists)]
    as_bytes = lambda x: [t.encode() for t in x]
    spans, who = Automaton([(o, as_bytes(x)) for o, x in lists], size).hits(as_bytes(tokens))
    hit, want = brute(" ".join(tokens), [(o, " ".join(x)) for o, x in lists], size)
    assert {i for a, b in spans for i in range(a, b)} == hit and who == want
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


LONG = " ".join(f"w{i % 7}x{i}" for i in range(30_000))
ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank"), (2, "Short ITEM"), (3, None), (4, "...!"),
    (5, "the quick brown fox jumps over the lazy dog near a house"), (None, "no id for this one of more than ten words in all"),
    (6, LONG), (2, "another text of item two"), (7, "é 𝄞 ünï"), (1, "The quick brown fox jumps over the lazy dog near the river bank"),
]
DOCS = [
    (1, "so The quick, brown fox jumps over the lazy dog NEAR the end"), (2, "a short item here, short\nitem"), (3, None), (4, ""),
    (5, "x " * 50_000 + ITEMS[5][1]), (6, LONG), (7, LONG[100_000:] + " É é 𝄞 ünï"), (1, "the quick brown fox"), (1, "the quick brown fox"),
    (None, "another text of item two"), (8, "é 𝄞 Ünï" + "\x00|~short`item@"),
]


@pytest.mark.parametrize("block", [200_000, 8_000, 400])
def test_rows(spark, block):
    docs = spark.createDataFrame([(*d, 7) for d in DOCS], "doc_id long, text string, spans int")
    items = spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id long, text string, source string")
    if block < 1000:  # many automata, cut chains
        items = items.where("item_id IS NULL OR item_id <> 6")
        block = 40
    out = find_leaks(docs, items, block=block).select("doc_id", "n_words", n_hit("spans").alias("n_hit"), "items").collect()
    chosen = [i for i in ITEMS if block > 40 or i[0] != 6]
    want = []
    for i, t in DOCS:
        hit, who = brute(t, chosen, 10)
        want.append((i, len(plain_words(t)), len(hit), sorted(who)))
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, want))


def test_empty(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert find_leaks(docs.where("doc_id > 99"), items).count() == 0
    none = find_leaks(docs, items.where("item_id > 99")).collect()
    assert len(none) == len(DOCS) and not any(r.spans or r.items for r in none)


def test_removal(spark):
    rows = [
        (1, "Keep this. one two Three, four five six seven eight nine ten! And 𝄞 this as well; it is clean by far, all of it."),
        (2, "one two three four five six seven eight nine ten"), (3, "clean"), (4, None), (5, "all of it ok, just ok and no more of this"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, "just ok")], "item_id long, text string")
    out = {r.doc_id: (r.text, r.removed) for r in remove_leaks(find_leaks(docs, items, keep=["text"])).collect()}
    assert out == {
        1: ("Keep this. ! And 𝄞 this as well; it is clean by far, all of it.", 10), 3: ("clean", 0), 4: (None, 0), 5: (rows[4][1], 0),
    }
    short = {r.doc_id: r.text for r in remove_leaks(find_leaks(docs, items, keep=["text"]), least=2, coverage=1.0).collect()}
    assert short[2] == "" and short[5] == "all of it ok,  and no more of this"


def test_query_and_sql(spark, tmp_path):
    small = [i for i in ITEMS if i[0] != 6]
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(small, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    df = QUERIES["op12_decontaminate"](spark, str(tmp_path))
    found = con.execute(SQL["op12_decontaminate"])
    assert [d[0] for d in found.description] == df.columns
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, found.fetchall()))
