"""Catalogs, listings and data files on disk."""

import json

import pytest
from conftest import docs, plan_of
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark import (
    Catalog,
    by_ids,
    cast_failures,
    catalog_from_responses,
    create_catalog,
    csv_fields,
    export_catalog_dir,
    infer_resources,
    infer_types,
    list_files,
    materialize,
    read_catalog,
    read_catalog_dir,
    read_catalog_json,
    read_catalog_lines,
    read_delimited,
    read_json_resource,
    read_resource,
    search_score,
    to_fields,
    to_struct,
    write_catalog,
    write_catalog_array,
    write_catalog_dir,
    write_catalog_json,
)


def put(root, files):
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(root)


def documents(catalog):
    return [(r.pos, json.loads(r.doc)) for r in catalog.orderBy("pos").select("pos", F.to_json("raw").alias("doc")).collect()]


SAMPLE = [{"id": f"d{i:02}", "name": f'na"me {i}', "nested": {"b": [1, {"x": None}], "a": "ü\n"}} for i in range(23)]


@pytest.fixture(scope="module")
def sample(spark):
    return docs(spark, *[json.dumps(d) for d in SAMPLE])


def test_folder_tree(spark, tmp_path):
    root = put(tmp_path, {
        "b/dataset.json": json.dumps({"id": "b"}, indent=2),
        "a/dataset.json": json.dumps({"id": "a", "tags": "one"}),
        "a/other.json": "{}",
        "c/readme.md": "no descriptor",
    })
    got = [(r.pos, r.id, r.tags) for r in read_catalog_dir(spark, root).orderBy("pos").collect()]
    assert got == [(0, "a", ["one"]), (1, "b", None)]


def test_json_array(spark, tmp_path):
    root = put(tmp_path, {"catalog.json": json.dumps(SAMPLE, indent=4)})
    assert documents(read_catalog_json(spark, f"{root}/catalog.json")) == list(enumerate(SAMPLE))


def test_round_trips(spark, sample, tmp_path):
    lines, array, folder, table = (str(tmp_path / n) for n in ("lines", "array", "dir", "table"))
    write_catalog_json(sample.repartition(5), lines)
    assert documents(read_catalog_lines(spark, lines)) == list(enumerate(SAMPLE))
    write_catalog_array(sample.repartition(5), array)
    assert documents(read_catalog_json(spark, array)) == list(enumerate(SAMPLE))
    single = tmp_path / "single"
    write_catalog_array(sample.repartition(5), str(single), single_file=True)
    (file,) = single.glob("part-*")
    assert json.loads(file.read_text()) == SAMPLE
    assert documents(read_catalog_json(spark, str(single))) == list(enumerate(SAMPLE))
    create_catalog(sample, folder)
    assert documents(read_catalog_dir(spark, folder)) == list(enumerate(SAMPLE))
    write_catalog(sample, table)
    assert documents(read_catalog(spark, table)) == list(enumerate(SAMPLE))
    assert "PushedFilters: [In(id, [d01,d02])]" in plan_of(by_ids(read_catalog(spark, table), ["d01", "d02"]).select("id"))


def test_search_reads_only_what_it_needs(spark, sample, tmp_path):
    path = str(tmp_path / "table")
    write_catalog(sample, path)
    found = search_score(read_catalog(spark, path), "na me", min_score=50).filter("source = 'git'")
    plan = found.select("id", "score")._jdf.queryExecution().toString()
    scan = plan[plan.index("== Physical Plan =="):]
    assert "raw" not in scan and "datapackage" not in scan
    assert "EqualTo(source,git)" in scan


def test_lines_over_several_files_and_blocks(spark, tmp_path):
    names = {f"part-{i}.json": "".join(json.dumps({"id": f"{i}-{j}"}) + "\n" for j in range(200)) for i in range(3)}
    root = put(tmp_path, names)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = [r.id for r in read_catalog_lines(spark, root).orderBy("pos").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"{i}-{j}" for i in range(3) for j in range(200)]


def test_empty_catalog(spark, sample, tmp_path):
    write_catalog_array(sample.limit(0), str(tmp_path / "none"))
    assert read_catalog_json(spark, str(tmp_path / "none")).count() == 0


def test_existing_targets(spark, sample, tmp_path):
    path = str(tmp_path / "c")
    create_catalog(sample, path)
    with pytest.raises(FileExistsError):
        create_catalog(sample, path)
    create_catalog(sample.limit(3), path, overwrite=True)
    assert read_catalog_dir(spark, path).count() == 3


def test_export(spark, sample, tmp_path):
    root = str(tmp_path / "c")
    export_catalog_dir(sample.repartition(3), root)
    assert documents(read_catalog_dir(spark, root)) == list(enumerate(SAMPLE))
    text = (tmp_path / "c" / "d04" / "dataset.json").read_text()
    assert text == json.dumps(SAMPLE[4], sort_keys=True, indent=4)
    export_catalog_dir(docs(spark, json.dumps({"id": "d04", "name": "new"})), root, ["d04"])
    assert [p.name for p in (tmp_path / "c" / "d04").iterdir() if not p.name.startswith(".")] == ["dataset.json"]
    assert dict(read_catalog_dir(spark, root).select("id", "name").collect())["d04"] == "new"
    with pytest.raises(Exception, match="no folder can be named"):
        export_catalog_dir(docs(spark, json.dumps({"id": "../x"})), root)


def test_replace_some(spark, sample, tmp_path):
    path = str(tmp_path / "c")
    create_catalog(sample, path)
    changed = docs(spark, json.dumps({"id": "d03", "name": "new"}), json.dumps({"id": "d04", "name": "not written"}))
    write_catalog_dir(changed, path, ["d03"])
    got = dict(read_catalog_dir(spark, path).select("id", "name").collect())
    assert len(got) == 23 and got["d03"] == "new" and got["d04"] == 'na"me 4'


def test_responses(spark):
    bodies = [(0, "u0", 200, '{"id":"a"}'), (1, "u1", 404, "gone"), (2, "u2", 200, '[{"id":"b"},{"id":"c"}]'), (3, "u3", 200, "<html>"), (4, "u4", 200, None), (5, "u5", None, "{}")]
    df = spark.createDataFrame(bodies, "pos long, uri string, status int, body string")
    good, bad = catalog_from_responses(df)
    assert [r.id for r in good.orderBy("pos").collect()] == ["a", "b", "c"]
    assert {(r.uri, r.reason) for r in bad.collect()} == {
        ("u1", "status is not 200"), ("u3", "body is not valid JSON"), ("u4", "body is not valid JSON"), ("u5", "status is not 200"),
    }


def test_listing(spark, tmp_path):
    root = put(tmp_path, {"a/x y.csv": "1\n", "a/.git/k": "22", "b.json": ""})
    files = {r.path: r["size"] for r in list_files(spark, root).collect()}
    assert files == {"a/x y.csv": 2, "a/.git/k": 2, "b.json": 0}
    assert {r.path for r in list_files(spark, root, ignore=[".git"]).collect()} == {"a/x y.csv", "b.json"}
    assert set(r.path for r in list_files(spark, root, glob="*.csv").collect()) == {"a/x y.csv"}


def declared(path, fields, **more):
    return {"path": path, "schema": {"fields": [{"name": n, "type": t} for n, t in fields], **more}}


def test_declared_types_and_missing_values(spark, tmp_path):
    root = put(tmp_path, {"t.csv": 'Date / Time,n,ok,day,s\n2020-01-02 03:04:05,1.5,true,2020-02-03,"a ""q"", b"\n,,,,\nbad,x,maybe,never,""\n'})
    fields = [("Date / Time", "datetime"), ("n", "number"), ("ok", "boolean"), ("day", "date"), ("s", "string")]
    rows = read_resource(spark, declared("t.csv", fields), root).collect()
    assert [r.s for r in rows] == ['a "q", b', None, None]
    assert rows[0].n == 1.5 and rows[0].ok is True and str(rows[0].day) == "2020-02-03"
    assert rows[2]["n"] is None and rows[2]["Date / Time"] is None
    kept = read_resource(spark, declared("t.csv", fields), root, keep_corrupt=True).collect()
    assert kept[0]["_corrupt_record"] is None and kept[2]["_corrupt_record"].startswith("bad,x")
    several = read_resource(spark, declared("t.csv", fields, missingValues=["", "bad", "x"]), root).collect()
    assert several[0].n == 1.5 and several[2].n is None


def test_quoted_line_breaks(spark, tmp_path):
    root = put(tmp_path, {"t.csv": 'a,b\n"one\ntwo",1\n'})
    rows = read_resource(spark, declared("t.csv", [("a", "string"), ("b", "integer")]), root, multi_line=True).collect()
    assert [tuple(r) for r in rows] == [("one\ntwo", 1)]


@pytest.mark.parametrize("codec", ["utf-8", "iso-8859-1", "windows-1252", "cp1251", "gbk", "shift_jis"])
def test_charsets(spark, tmp_path, codec):
    text = {"cp1251": "Привет", "gbk": "数据", "shift_jis": "データ", "windows-1252": "“café…”"}.get(codec, "café")
    root = put(tmp_path, {"t.csv": f"a,b\n{text},1\n".encode(codec)})
    resource = {**declared("t.csv", [("a", "string"), ("b", "integer")]), "encoding": codec}
    assert [tuple(r) for r in read_resource(spark, resource, root).collect()] == [(text, 1)]
    leaf = {"path": f"{root}/t.csv", "decode": codec, "format": "csv"}
    assert [tuple(r) for r in read_delimited(spark, leaf).collect()] == [(text, 1)]
    assert [tuple(r) for r in read_delimited(spark, {**leaf, "comment": "#"}).collect()] == [(text, 1)]


def test_comments_and_separators(spark, tmp_path):
    root = put(tmp_path, {"t.txt": '# made by hand\na;b;c\n1;"x # y";2.5# why\n\n# end\n2;z;3\n'})
    leaf = {"path": f"{root}/t.txt", "seperator": ";", "comment": "#"}
    df = read_delimited(spark, leaf)
    assert [tuple(r) for r in df.orderBy("a").collect()] == [(1, "x # y", 2.5), (2, "z", 3.0)]
    assert {c: t for c, t in df.dtypes} == {"a": "bigint", "b": "string", "c": "double"}
    assert set(dict(read_delimited(spark, leaf, infer=False).dtypes).values()) == {"string"}


def test_json_resource(spark, tmp_path):
    root = put(tmp_path, {"t.json": '[{"a":1,"b":"x"},\n {"a":2,"b":null}]'})
    df = read_json_resource(spark, {"path": f"{root}/t.json", "format": "json"})
    assert sorted(tuple(r) for r in df.collect()) == [(1, "x"), (2, None)]
    with pytest.raises(ValueError):
        read_json_resource(spark, {"path": "x", "format": "xlsx"})


def test_headers_and_types_of_different_files(spark, tmp_path):
    root = put(tmp_path, {
        "d1/data/a.csv": "id,Date / Time,flag\n1,2020-01-01,true\n2,2021-12-31,FALSE\n",
        "d1/data/b.csv": "x\n" + "1.5\n" * 3 + "oops\n",
        "d1/notes.txt": "not,a,table\n",
        "d1/.git/hidden.csv": "h\n",
        "d1/data/a +%20.csv": "k\n7\n",
        "d2/only.csv": "name,n\ncafé,1\n".encode("iso-8859-1"),
        "d2/win.csv": "naïve\n“q”\n".encode("windows-1252"),
        "d2/utf.csv": "größe\n1\n",
        "d2/empty.csv": "p,q\n",
        "d2/nothing.csv": "",
    })
    got = {
        (r.dataset_id, r.pos): (r.name, r.path, r.encoding, [(f.name, f.type) for f in r.schema.fields])
        for r in infer_resources(spark, root).collect()
    }
    assert got == {
        ("d1", 0): ("a +%20", "data/a +%20.csv", "utf-8", [("k", "integer")]),
        ("d1", 1): ("a", "data/a.csv", "utf-8", [("id", "integer"), ("Date / Time", "date"), ("flag", "boolean")]),
        ("d1", 2): ("b", "data/b.csv", "utf-8", [("x", "number")]),
        ("d2", 0): ("empty", "empty.csv", "utf-8", [("p", "string"), ("q", "string")]),
        ("d2", 1): ("nothing", "nothing.csv", "utf-8", []),
        ("d2", 2): ("only", "only.csv", "iso-8859-1", [("name", "string"), ("n", "integer")]),
        ("d2", 3): ("utf", "utf.csv", "utf-8", [("größe", "integer")]),
        ("d2", 4): ("win", "win.csv", "windows-1252", [("naïve", "string")]),
    }
    fields = {r.path: [f.name for f in r.fields] for r in csv_fields(list_files(spark, root, glob="*.csv")).collect()}
    assert fields["d1/data/a.csv"] == ["id", "Date / Time", "flag"]


def test_header_with_line_break(spark, tmp_path):
    root = put(tmp_path, {"d/t.csv": '"two\nlines",b\n"x\ny",2\n'})
    got = infer_resources(spark, root, multi_line=True).first()
    assert [(f.name, f.type) for f in got.schema.fields] == [("two\nlines", "string"), ("b", "integer")]


def test_infer_types(spark):
    df = spark.createDataFrame([("1", "1.5", "a", "", "2020-01-01 10:00:00")] * 3 + [("x", "2", "b", None, "2020-01-01T10:00")], "i string, n string, s string, none string, t string")
    got = {r.column: r.type for r in infer_types(df).collect()}
    assert got == {"i": "integer", "n": "number", "s": "string", "none": "string", "t": "datetime"}
    assert {r.column: r.type for r in infer_types(df, confidence=1.0).collect()}["i"] == "string"
    failed = {r.column: (r.n_missing, r.n_failed) for r in cast_failures(df, [{"name": "i", "type": "integer"}, {"name": "none", "type": "date"}]).collect()}
    assert failed == {"i": (0, 1), "none": (4, 0)}


def test_type_mapping():
    fields = [{"name": n, "type": n, "format": "default"} for n in ("string", "integer", "number", "boolean", "date", "datetime", "array", "object")]
    struct = to_struct(fields)
    assert struct["integer"].dataType == T.LongType() and struct["array"].dataType == T.VariantType()
    assert [f["type"] for f in to_fields(struct)] == ["string", "integer", "number", "boolean", "date", "datetime", "object", "object"]
    assert to_struct(fields, T.DecimalType(38, 18))["number"].dataType == T.DecimalType(38, 18)


def test_materialize_and_catalog(spark, tmp_path):
    base = put(tmp_path / "base", {"d/one.csv": "a,b\n1,x\n2,y\n", "d/two.csv": "c\n1.5\n"})
    resource = lambda name, fields: {"name": name, "path": f"{name}.csv", "format": "csv", "schema": {"fields": [{"name": n, "type": t} for n, t in fields]}}
    doc = {"id": "d", "name": "demo", "source": "git", "datapackage": {"resources": [resource("one", [("a", "integer"), ("b", "string")]), resource("two", [("c", "number")])]}}
    catalog = Catalog(docs(spark, json.dumps(doc), json.dumps({"id": "far", "source": "s3", "datapackage": {"resources": [{"name": "x", "path": "x.csv"}]}})))
    here = spark.createDataFrame([("d",)], "id string")
    dest = str(tmp_path / "dest")
    written = materialize(catalog.datasets, ["d"], dest, here, base)
    assert written == [f"{dest}/d/one", f"{dest}/d/two"]
    assert sorted(tuple(r) for r in spark.read.parquet(written[0]).collect()) == [(1, "x"), (2, "y")]
    with pytest.raises(FileExistsError):
        materialize(catalog.datasets, ["d"], dest, here, base)
    assert materialize(catalog.datasets, ["d"], dest, here, base, refresh=True) == written
    with pytest.raises(ValueError):
        materialize(catalog.datasets, ["far"], dest, here, base)

    assert [r.c for r in catalog.read("d", here, base, name="two").collect()] == [1.5]
    with pytest.raises(LookupError):
        catalog.read("d", here, base, name="none")
    assert catalog.metadata("d") == doc and catalog.metadata("none") is None
    assert catalog.search("demo").first()["id"] == "d"
    bigger, rejected = catalog.add(docs(spark, json.dumps({"id": "e"}), json.dumps({"id": "d"})))
    assert bigger.datasets.count() == 3 and [r.id for r in rejected.collect()] == ["d"]
    bigger.remove(["far"]).save(str(tmp_path / "saved"))
    again = Catalog.open(spark, str(tmp_path / "saved"))
    assert sorted(r.id for r in again.datasets.collect()) == ["d", "e"]
    assert again.resources("d").count() == 2
