"""Records cut by blocks: JSON arrays and delimited files with quoted breaks and comments."""

import csv
import io
import json

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark import read_catalog_json, read_catalog_json_blocks, read_delimited
from shelfmark.sources import blocks


def listed(path, size, block):
    starts = list(range(0, max(size, 1), block))
    return pa.RecordBatch.from_pydict(
        {"uri": [f"file://{path}"] * len(starts), "size": [size] * len(starts), "block": list(range(len(starts))), "start": starts}
    )


def rows(batches):
    return [tuple(r.values()) for b in batches for r in b.to_pylist()]


def json_records(path, data, block):
    path.write_bytes(data)
    steps = blocks._json_steps(block)(iter([listed(path, len(data), block)]))
    return [r[1:] for r in rows(blocks._json_records(block)(blocks._json_entered(steps)))]


def delimited(path, data, block, **marks):
    path.write_bytes(data)
    kind = blocks.Delimited(**marks)
    steps = blocks._delimited_steps(kind, block)(iter([listed(path, len(data), block)]))
    return [r[2] for r in rows(blocks._delimited_records(kind, block)(blocks._delimited_entered(steps)))]


values = st.recursive(
    st.none() | st.booleans() | st.integers(-9, 99) | st.text(alphabet='a"\\[]{},é𝄞 \n', max_size=6),
    lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(alphabet='k"\\,]', max_size=3), x, max_size=3),
    max_leaves=8,
)


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(values, max_size=6), st.integers(1, 40), st.booleans(), st.sampled_from([None, 1]))
def test_json(tmp_path, items, block, ascii_, indent):
    data = ("﻿" if indent else "") + " " * (len(items) % 3) + json.dumps(items, ensure_ascii=ascii_, indent=indent) + "\n "
    found = json_records(tmp_path / "t.json", data.encode(), block)
    assert [json.loads(body) for _, body, _ in found] == items and all(whole for *_, whole in found)
    assert [at for at, *_ in found] == sorted({at for at, *_ in found})


@pytest.mark.parametrize("block", [1, 2, 3, 7, 100])
def test_json_faults(tmp_path, block):
    path = tmp_path / "t.json"
    assert json_records(path, b"", block) == json_records(path, b" \n", block) == json_records(path, b" [ \n]", block) == []
    assert json_records(path, b'  {"a":[1,2]}', block) == [(((len("  ") // block) * block), '  {"a":[1,2]}', False)]
    assert json_records(path, b'[1, {"a": "x', block) == [(1, "1", True), (3, ' {"a": "x', False)]
    behind = json_records(path, b"[1,2] x ", block)
    assert behind[:2] == [(1, "1", True), (3, "2", True)] and "".join(b for _, b, w in behind if not w).strip() == "x"


def plain(text, sep=",", comment=None):
    """Records character by character."""
    out, state, record, i = [], "field", "", 0
    while i < len(text):
        c = text[i]
        if state == "comment":
            if c == "\n":
                out.append(record)
                record, state = "", "field"
        elif state == "quoted":
            record += c
            if c == '"':
                if text[i + 1 : i + 2] == '"':
                    record += '"'
                    i += 1
                else:
                    state = "plain"
        elif c == "\n":
            out.append(record)
            record, state = "", "field"
        elif c == comment:
            state = "comment"
        else:
            state = "field" if c == sep else "quoted" if c == '"' and state == "field" else "plain"
            record += c
        i += 1
    return [r.removesuffix("\r") for r in [*out, record] if r.removesuffix("\r").strip(" ")]


@settings(max_examples=500, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet='ab",\n#\r ', max_size=60), st.integers(1, 25), st.sampled_from([None, "#"]))
def test_delimited(tmp_path, text, block, comment):
    mark = "\ufeff" * (len(text) % 2 and block > 2)
    found = delimited(tmp_path / "t.csv", (mark + text).encode(), block, comment=comment)
    assert [d.decode() for d in found] == plain(text, comment=comment)


cells = st.text(alphabet='ab"\n,#é ', max_size=8)


@settings(max_examples=200, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(cells, cells), min_size=1, max_size=8), st.integers(1, 30))
def test_delimited_round_trip(tmp_path, table, block):
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="\n").writerows(table)
    found = delimited(tmp_path / "t.csv", out.getvalue().encode(), block, comment="#")
    assert [tuple(next(csv.reader(io.StringIO(d.decode(), newline="")))) for d in found] == table


def test_catalog(spark, tmp_path):
    many = [{"id": f"d{i}", "name": 'br{ack"et]s, \\', "tags": [f"{i}", "é\n"]} for i in range(500)]
    (tmp_path / "good").mkdir()
    (tmp_path / "good" / "a.json").write_text(json.dumps(many[:300], indent=2))
    (tmp_path / "good" / "b.json").write_text(json.dumps(many[300:]))
    (tmp_path / "good" / "c.json").write_text(" ")
    path = str(tmp_path / "good")
    pick = lambda df: [(r.pos, r.id, r.name, r.tags) for r in df.orderBy("pos").collect()]
    by_blocks = read_catalog_json_blocks(spark, path, block=1000)
    assert pick(by_blocks) == pick(read_catalog_json(spark, path)) == [(i, d["id"], d["name"], d["tags"]) for i, d in enumerate(many)]
    records = blocks.json_array_records(spark, path, block=1000)
    assert records.select(F.spark_partition_id()).distinct().count() > 8  # one file is many tasks
    (tmp_path / "bad.json").write_text('[{"id":"x"}, 5, {"id":}, {"id":"y"}] behind')
    good, bad = read_catalog_json_blocks(spark, str(tmp_path / "bad.json"), with_rejects=True, block=6)
    assert [(r.pos, r.id) for r in good.orderBy("pos").collect()] == [(0, "x"), (1, "y")]
    got = sorted((r["index"], r.body.strip(), r.reason) for r in bad.collect())
    assert got[:2] == [(12, "5", "not a JSON object"), (15, '{"id":}', "not valid JSON")] and "".join(b for _, b, _ in got[2:]) == "behind"
    with pytest.raises(Exception, match="no descriptor"):
        read_catalog_json_blocks(spark, str(tmp_path / "bad.json")).collect()


def test_read_delimited(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('# about\nk,text # header\n1,"x\ny#z"# note, "here"\n\n2,"a ""b"", c"\n3,it\'s 5" wide\n4,"' + "long\n" * 20_000 + '"\n5,#\n')
    want = [(1, "x\ny#z"), (2, 'a "b", c'), (3, 'it\'s 5" wide'), (4, "long\n" * 20_000), (5, None)]
    for block in (1 << 12, 1 << 20):  # the long record goes through many blocks of the first kind
        df = read_delimited(spark, {"path": str(path), "comment": "#"}, block=block).orderBy("k")
        assert [tuple(r) for r in df.collect()] == want
    (tmp_path / "w.csv").write_bytes('k;t\n1;"“é”\n€"\n'.encode("windows-1252"))
    df = read_delimited(spark, {"path": str(tmp_path / "w.csv"), "seperator": ";", "decode": "windows-1252"}, quoted_breaks=True, block=4)
    assert [tuple(r) for r in df.collect()] == [(1, "“é”\n€")]
    (tmp_path / "none.csv").write_text("# only\n\n")
    with pytest.raises(ValueError, match="no header"):
        read_delimited(spark, {"path": str(tmp_path / "none.csv"), "comment": "#"})
