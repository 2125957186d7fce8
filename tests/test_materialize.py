"""Tables of many data files: jobs by form, whole results, refusals, commits."""

import glob
import json
import os

import pytest
from conftest import docs

from shelfmark import materialize, materialize_many, read_resource
from shelfmark.sinks import materialize as module


def resource(name, fields, **more):
    schema = {"fields": [{"name": n, "type": t} for n, t in fields], "missingValues": more.pop("missing", [""])}
    return {"name": name, "path": more.pop("path", f"{name}.csv"), "format": "csv", "schema": schema, **more}


@pytest.fixture
def many(spark, tmp_path):
    """(catalog, base, what every table holds): 40 datasets of 5 files, one of each form."""
    base, documents, want = tmp_path / "base", [], {}
    for i in range(40):
        folder = base / f"d {i:02}"
        (folder / "part").mkdir(parents=True)
        (folder / "a%+.csv").write_text(f"x,y\n{i},é{i}\n{i + 1},\n")
        (folder / "b.csv").write_text(f"y,x,more\nz,{i},1\n")  # another order, one more column
        (folder / "c.csv").write_bytes(f"x,y\n{i},é\n".encode("latin-1"))
        (folder / "e.json").write_text(json.dumps([{"x": str(i), "y": "n/a"}, {"y": "t", "x": 2.5}]))
        for part in range(3):
            (folder / "part" / f"{part}.csv").write_text("v\n" + f"{part}.5\n" * (part + i % 2))
        (folder / "part" / "_skip.csv").write_text("v\n9\n")
        xy = [("x", "integer"), ("y", "string")]
        resources = [
            resource("a", xy, path="a%+.csv"), resource("b", xy), resource("c", xy, encoding="iso-8859-1"),
            resource("e", xy, path="e.json", format="JSON", missing=["", "n/a"]), resource("f", [("v", "number")], path="part"),
        ]
        documents.append(json.dumps({"id": f"d {i:02}", "source": "git", "datapackage": {"resources": resources}}))
        want[f"d {i:02}/a"] = [(i, f"é{i}"), (i + 1, None)]
        want[f"d {i:02}/b"] = [(i, "z")]
        want[f"d {i:02}/c"] = [(i, "é")]
        want[f"d {i:02}/e"] = [(i, None), (None, "t")]
        want[f"d {i:02}/f"] = sorted((part + 0.5,) for part in range(3) for _ in range(part + i % 2))
    return docs(spark, *documents), str(base), want


def contents(spark, manifest):
    found = {}
    for r in manifest.collect():
        rows = spark.read.parquet(r.table).collect()
        found["/".join(r.table.split("/")[-2:])] = sorted((tuple(x) for x in rows), key=str)
        assert len(glob.glob(f"{glob.escape(r.table)}/*.parquet")) == r.n_files > 0 and r.bytes > 0
    return found


def test_groups(spark, many, tmp_path, monkeypatch):
    catalog, base, want = many
    writes = []
    write = module._write
    monkeypatch.setattr(module, "_write", lambda *a: writes.append(a[2]) or write(*a))
    dest = f"{tmp_path}/dest"
    manifest = materialize_many(catalog, None, dest, catalog.select("id"), base)
    assert manifest.columns == ["dataset_id", "pos", "name", "path", "table", "n_files", "bytes"]
    assert len(writes) == 5
    assert contents(spark, manifest) == {k: sorted(v, key=str) for k, v in want.items()}
    assert not glob.glob(f"{dest}/.staged*") and not glob.glob(f"{dest}/*/.*-*")
    # every table is there: nothing is written again, unless it is refreshed
    with pytest.raises(FileExistsError):
        materialize_many(catalog, None, dest, catalog.select("id"), base)
    with open(f"{base}/d 00/b.csv", "a") as out:
        out.write("new,77,1\n")
    one = spark.createDataFrame([("d 00",), ("absent",)], "id string")
    again = materialize_many(catalog, one, dest, catalog.select("id"), base, refresh=True, files_per_job=2, parallel=3)
    want["d 00/b"].append((77, "new"))
    assert contents(spark, again) == {k: sorted(v, key=str) for k, v in want.items() if k.startswith("d 00/")}
    assert len(writes) == 5 + 6  # three files of one form, two a job
    assert len(os.listdir(f"{dest}/_manifests")) >= 2


def test_no_rows(spark, tmp_path):
    """Files of a header only give an empty table with the declared columns."""
    (tmp_path / "d").mkdir()
    for name in "pq":
        (tmp_path / "d" / f"{name}.csv").write_text("a,b\n")
    doc = {"id": "d", "datapackage": {"resources": [resource(n, [("b", "integer"), ("a", "date")]) for n in "pq"]}}
    catalog = docs(spark, json.dumps(doc))
    for path in materialize(catalog, ["d"], f"{tmp_path}/dest", catalog.select("id"), str(tmp_path)):
        rows = spark.read.parquet(path)
        assert rows.dtypes == [("b", "bigint"), ("a", "date")] and rows.count() == 0
    assert materialize_many(catalog, ["none"], f"{tmp_path}/dest", catalog.select("id"), str(tmp_path)).count() == 0


def test_refusals(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "p.csv").write_text("a\n1\n")
    here = spark.createDataFrame([("d",)], "id string")

    def run(*resources, **more):
        catalog = docs(spark, json.dumps({"id": "d", "datapackage": {"resources": list(resources)}, **more}))
        return materialize_many(catalog, None, f"{tmp_path}/dest", here.where(f"'{more.get('source')}' <> 's3'"), str(tmp_path))

    good = resource("p", [("a", "integer")])
    with pytest.raises(FileNotFoundError):
        run(good, resource("gone", [("a", "integer")]))
    with pytest.raises(ValueError):
        run(good, source="s3")
    with pytest.raises(ValueError):
        run(resource("p", [("b", "integer")]))
    with pytest.raises(ValueError):  # a name that another one gets from its position
        run({**good, "name": "p-1"}, {**good, "name": "p"}, {**good, "name": "p"})
    assert not os.path.exists(f"{tmp_path}/dest/d")


def test_repeated_names_of_a_header(spark, tmp_path):
    (tmp_path / "t.csv").write_text("b,a,b\n1,x,2\nbad,y,3\n")
    declared = {"path": f"{tmp_path}/t.csv", "schema": {"fields": [{"name": "a", "type": "string"}, {"name": "b", "type": "integer"}]}}
    assert [tuple(r) for r in read_resource(spark, declared).collect()] == [("x", 1), ("y", None)]
    kept = read_resource(spark, declared, keep_corrupt=True)
    assert [tuple(r) for r in kept.collect()] == [("x", 1, None), ("y", None, "bad,y,3")]


def test_json_as_declared(spark, tmp_path):
    body = '[{"a":"n/a","b":"5","c":{"k":[1]}},{"a":"x","b":5,"d":1},{"b":"five","a":""}]'
    (tmp_path / "t.json").write_text(body)
    fields = [{"name": n, "type": t} for n, t in (("b", "integer"), ("a", "string"), ("c", "object"))]
    declared = {"path": f"{tmp_path}/t.json", "format": "json", "schema": {"fields": fields, "missingValues": ["", "n/a"]}}
    rows = [(r.b, r.a, r.c and r.c.toPython()) for r in read_resource(spark, declared).collect()]
    assert rows == [(5, None, {"k": [1]}), (5, "x", None), (None, None, None)]
    kept = [r._corrupt_record for r in read_resource(spark, declared, keep_corrupt=True).collect()]
    assert kept[:2] == [None, None] and json.loads(kept[2]) == {"b": "five", "a": ""}
    (tmp_path / "t.json").write_text("{broken")
    assert [r._corrupt_record for r in read_resource(spark, declared, keep_corrupt=True).collect()] == ["{broken"]
