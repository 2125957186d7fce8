"""Fill-in-middle: against a plain computation, round trips, awkward rows, the SQL twin."""

import hashlib
import re

import duckdb
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.llm.fim import UNIT, Rule, cut, fill_in_middle, restored
from shelfmark.llm.oracles import SQL
from shelfmark.llm.queries import QUERIES

UNITS = regex.compile(f"((?>{UNIT}))*+")


def plain(text, key):
    """The same by a list of units."""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digits = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h = [int(digits[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not n or h[2] % 100 >= 90 or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted(x % (n + 1) for x in h[:2])
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab<PSM> \n\r\x00é𝄞Z", max_size=60), st.integers())
def test_cut(text, key):
    assert cut(text, str(key), UNITS) == plain(text, str(key))


def rows():
    texts = ["", None, "a", "<", "ab <P> c", "\n\r\n", "é𝄞 word's end.", "x" * 100_000, "a b " * 30_000, "<S", "S> <S <M", ">>><<<"]
    return [(i, t, "x") for i in range(0, 60) for t in texts] + [(None, "no id", None), (1, "a", "x"), (1, "a", "x")]


def test_rows(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, form string")
    out = fill_in_middle(df).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    want = [(i, *plain(t or "", "" if i is None else i), t or "") for i, t, _ in rows()]
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, want))
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert fill_in_middle(df.where("doc_id < 0")).count() == 0


def test_marks_and_kept_columns(spark):
    rule = Rule("[pre]", "[suf]", "[mid]", percent=100, spm_percent=100, unit="(?s:.)")
    df = spark.createDataFrame([(i, "abc [pre", "x") for i in range(9)], "id long, body string, source string")
    out = fill_in_middle(df, "id", "body", keep=["source"], rule=rule)
    assert out.columns == ["id", "source", "n", "form", "prefix_chars", "middle_chars", "output"]
    back = out.select("n", "form", restored(F.col("output"), F.col("form"), rule)).distinct().collect()
    assert [tuple(r) for r in back] == [(8, "spm", "abc [pre")]


def test_query_and_sql(spark, tmp_path):
    spark.createDataFrame(rows(), "doc_id long, text string, form string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = QUERIES["op11_fill_in_middle"](spark, str(tmp_path))
    found = con.execute(SQL["op11_fill_in_middle"])
    assert [d[0] for d in found.description] == df.columns
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, found.fetchall()))
    assert df.where("output_sha256 = restored_sha256 AND form <> 'plain'").count() == 0
