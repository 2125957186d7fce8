"""Chat formatting: folding, escaping, spans, and the SQL twin on awkward rows."""

import hashlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm.chat import LEARNED, apply_event, escape, format_chats, read_chats, read_turns, render, unescape
from shelfmark.llm.oracles import SQL
from shelfmark.llm.queries import QUERIES

EVENTS = "conv_id long, seq long, kind string, turn long, role string, text string, formatted string"


def test_fold(spark):
    log = [
        (1, 0, "message", 0, "user", "hi"),
        (1, 1, "delta", 1, "assistant", "he"),
        (1, 2, "delta", 1, "assistant", "llo"),
        (1, 3, "message", 2, "user", "more"),
        (1, 4, "edit", 0, None, "hey"),
        (1, 5, "regenerate", 1, "assistant", "x"),
        (1, 6, "delta", 1, None, "<|end|>\n"),
        (2, 1, None, 5, "assistant", None),
        (2, None, "edit", 9, "tool\n", "new"),
        (None, 1, "message", None, None, "nobody"),
    ]
    df = spark.createDataFrame([(*e, "x") for e in reversed(log)], EVENTS)
    out = {r.conv_id: r for r in format_chats(df).collect()}
    assert read_turns(out[1].formatted) == [("user", "hey"), ("assistant", "x<|end|>\n")]
    assert [unescape(out[1].formatted[a:b]) for a, b in out[1].spans] == ["x<|end|>\n"]
    assert read_turns(out[2].formatted) == [("assistant", ""), ("tool\n", "new")]
    assert read_turns(out[None].formatted) == [("", "nobody")]
    assert format_chats(df.where("seq > 99")).count() == 0
    with pytest.raises(ValueError):
        apply_event([], "rename", 1, "a", "b")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", LEARNED, "", "<|turn|>\n\\"]), st.text(alphabet="\\<|n>endtur\n é𝄞"))))
def test_round_trip(turns):
    formatted, spans = render([(i, r, [t]) for i, (r, t) in enumerate(turns)])
    assert read_turns(formatted) == turns
    assert [unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == LEARNED]
    assert all(unescape(escape(t)) == t for _, t in turns)


def test_query_and_sql(spark, tmp_path):
    rows = [(5, 0, "user", "a\\n<|end|>"), (5, 1, "assistant", None), (5, 1, "assistant", "b"), (5, 1, "assistant", "b")]
    rows += [(6, None, "assistant", "𝄞" * 100_000), (6, 0, None, "<<|"), (7, 2, "sys\ntem", ""), (8, 0, "assistant", "<")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    df = QUERIES["op8_chat_format"](spark, str(tmp_path))
    got = sorted(tuple(r) for r in df.collect())
    found = con.execute(SQL["op8_chat_format"])
    names = [d[0] for d in found.description]
    assert names == df.columns and got == sorted(found.fetchall())
    said = r"\### Assistant: </turn> ok"
    assert got[0][:5] == (
        -7, 2, hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest(), len(said),
        hashlib.sha256(said.encode()).hexdigest(),
    )


def test_read_back_of_nothing(spark):
    df = spark.createDataFrame([], EVENTS)
    assert read_chats(format_chats(df)).count() == 0
