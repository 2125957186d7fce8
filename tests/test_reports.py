"""Validation reports, descriptions, locations and pages on hand-written rows."""

import json

import pytest
from conftest import docs
from pyspark.sql import functions as F

from shelfmark import (
    LEAF,
    describe,
    explode_fields,
    explode_resources,
    filter_report,
    full_metadata,
    legacy_urls,
    list_folders,
    parse_repo_urls,
    render_pages,
    resolve_paths,
    resource_tree,
    roll_up,
    slug_index,
    summary,
    validate,
    validate_descriptors,
    with_format,
    with_metadata_uri,
)


def leaf(pos, **changes):
    row = {
        "dataset_id": "d", "pos": pos, "name": "n", "description": "text", "path": f"f{pos}.csv",
        "format": "csv", "size": 10, "updated_at": "", "fields": [("a", "first"), ("b", "second")],
    }
    return tuple({**row, **changes}.values())


@pytest.fixture(scope="module")
def report(spark):
    leaves = [
        leaf(0), leaf(1, path=""), leaf(2, path="nowhere.csv"), leaf(3, format=""), leaf(4, description=""),
        leaf(5, size=None), leaf(6, size=0), leaf(7, fields=[]), leaf(8, fields=None),
        leaf(9, fields=[("", "x")]), leaf(10, fields=[("a", ""), ("b", "x")]), leaf(11, fields=[(None, None), ("b", "")]),
        leaf(12, path=None, format=None, description=None),
    ]
    files = spark.createDataFrame([(f"f{i}.csv",) for i in range(12)], "path string")
    return validate(spark.createDataFrame(leaves, LEAF), files).cache()


def test_report(report):
    got = {(r.pos, r.check): (r.value, r.status, r.message) for r in report.collect()}
    assert len(got) == 13 * 5
    assert [got[0, c][1] for c in ("path", "format", "description", "size", "fields")] == ["success"] * 5
    assert got[0, "path"] == ("f0.csv", "success", "f0.csv was found")
    assert got[0, "size"] == ("10", "success", "10 exists")
    assert got[0, "fields"] == ("2 fields in total", "success", "2 fields: all names and descriptions filled in.")
    assert got[1, "path"] == ("", "error", "path is missing")
    assert got[2, "path"] == ("nowhere.csv", "error", "nowhere.csv was not found")
    assert got[3, "format"] == ("", "error", "format is missing")
    assert got[4, "description"] == ("", "warning", "description is missing")
    assert got[5, "size"] == (None, "warning", "size is missing")
    assert got[6, "size"] == ("0", "warning", "size is missing")
    assert got[7, "fields"] == got[8, "fields"] == ("0 fields in total", "warning", "fields is missing")
    assert got[9, "fields"][1:] == ("error", "1 fields: 1 names missing; 0 descriptions missing.")
    assert got[10, "fields"][1:] == ("warning", "2 fields: 1 descriptions missing.")
    assert got[11, "fields"][1:] == ("error", "2 fields: 1 names missing; 2 descriptions missing.")
    assert got[12, "path"][1:] == ("error", "path is missing")


def test_levels(report):
    status = lambda level: {r.status for r in filter_report(report, level).collect()}
    assert status("warning") == {"warning", "error"}
    assert status("error") == {"error"}
    assert status("all") == {"success"}
    assert filter_report(report, None).count() == report.count()
    with pytest.raises(ValueError):
        filter_report(report, "loud")
    assert roll_up(report).agg(F.sum("n")).first()[0] == 65


def test_descriptor_folders(spark):
    folders = spark.createDataFrame([("a",), ("b",), ("c",)], "folder string")
    found = spark.createDataFrame([("a", "{}"), ("b", "{")], "folder string, value string")
    got = {r.folder: (r.status, r.message) for r in validate_descriptors(folders, found).collect()}
    assert got == {
        "a": ("success", "descriptor exists"),
        "b": ("error", "descriptor is not valid JSON"),
        "c": ("error", "descriptor is missing"),
    }


def field(name, kind="string"):
    return {"name": name, "type": kind, "format": "default"}


JOBS = {
    "id": "git-jobs",
    "name": "jobs",
    "description": "listings",
    "source": "git",
    "uri": "https://github.com/owner/jobs.git",
    "metadata_uri": "https://raw.githubusercontent.com/owner/jobs/main/dataset.json",
    "contributors": [{"name": "Ann", "github": "ann"}, {"name": "Bo"}],
    "tags": ["a", "b"],
    "category": "work",
    "datapackage": {
        "profile": "tabular-data-package",
        "resources": [
            {"name": "one", "path": "dataset/one.csv", "encoding": "windows-1252", "schema": {"fields": [field("Date / Time"), field("id", "integer")], "missingValues": [""]}},
            {"name": "two", "path": "dataset/two.csv", "schema": {"fields": [field("x", "number")]}},
        ],
    },
}


@pytest.fixture(scope="module")
def catalog(spark):
    return docs(spark, json.dumps(JOBS), json.dumps({"id": "s", "source": "s3", "uri": "s3://b/s/", "tags": "solo", "datapackage": {"resources": [{"path": "x.csv"}]}}), "{}")


def test_shapes(catalog):
    assert [(r.dataset_id, r.pos, r.path) for r in explode_resources(catalog).collect()] == [
        ("git-jobs", 0, "dataset/one.csv"), ("git-jobs", 1, "dataset/two.csv"), ("s", 0, "x.csv"),
    ]
    assert explode_resources(catalog, outer=True).count() == 4
    fields = [(r.dataset_id, r.resource_pos, r.field_pos, r.field, r.type) for r in explode_fields(catalog).collect()]
    assert fields == [
        ("git-jobs", 0, 0, "Date / Time", "string"), ("git-jobs", 0, 1, "id", "integer"), ("git-jobs", 1, 0, "x", "number"),
    ]
    trees = {r.id: r.paths for r in resource_tree(catalog).collect()}
    assert trees == {"git-jobs": ["dataset/one.csv", "dataset/two.csv"], "s": ["x.csv"], "": []}
    lines = {r.id: r.line for r in describe(catalog).collect()}
    assert lines["git-jobs"] == "Dataset ID: git-jobs\nname: jobs\ndescription: listings\ncontributors: Ann, Bo"
    assert json.loads(full_metadata(catalog).first()["metadata"]) == JOBS
    keys = [(r.key, r.value) for r in summary(catalog, site=True).filter("id = 's'").collect()]
    assert keys == [("Name", None), ("Dataset ID", "s"), ("Source Type", "s3"), ("URI", "s3://b/s/"), ("Metadata URI", ""), ("Category", None), ("Tags", "solo")]


def test_locations(spark, catalog):
    here = spark.createDataFrame([("s",), ("s",)], "id string")
    got = {(r.dataset_id, r.pos): (r.kind, r.location, r.supported) for r in resolve_paths(catalog, here, "/w").collect()}
    assert got == {
        ("git-jobs", 0): ("git", "https://raw.githubusercontent.com/owner/jobs/main/dataset/one.csv", True),
        ("git-jobs", 1): ("git", "https://raw.githubusercontent.com/owner/jobs/main/dataset/two.csv", True),
        ("s", 0): ("local", "/w/s/x.csv", True),
    }
    lone = resolve_paths(catalog.filter("id = 's'"), here.filter("id = ''"), "/w").first()
    assert (lone.kind, lone.location, lone.supported) == ("direct", "x.csv", False)


def test_metadata_uris(spark, catalog):
    good, bad = with_metadata_uri(catalog)
    assert {r.id: r.metadata_uri for r in good.collect()} == {
        "git-jobs": "https://raw.githubusercontent.com/owner/jobs/main/dataset.json", "s": "s3://b/s/dataset.json",
    }
    assert [r.id for r in bad.collect()] == [""]
    plain = spark.createDataFrame([("git", "https://github.com/owner/records")], "source string, uri string")
    assert with_metadata_uri(plain)[0].first()["metadata_uri"].endswith("/owner/records/main/dataset.json")
    assert with_metadata_uri(plain, legacy=True)[0].first()["metadata_uri"].endswith("/owner/rec/main/dataset.json")


def test_repository_urls(spark):
    urls = [
        "https://github.com/owner/jobs/blob/main/dataset.json", "git@github.com:owner/jobs.git",
        "ssh://git@github.com:22/owner/jobs.git", "https://elsewhere.org/owner/jobs",
    ]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = {r.u: r for r in parse_repo_urls(df, "u").collect()}
    first = got[urls[0]]
    assert first.metadata_uri == "https://raw.githubusercontent.com/owner/jobs/blob/main/dataset.json"
    assert (first.protocol, first.host, first.owner, first.name) == ("https", "github.com", "owner", "jobs")
    assert (got[urls[1]].protocol, got[urls[1]].owner, got[urls[1]].name) == ("ssh", "owner", "jobs")
    assert (got[urls[2]].host, got[urls[2]].path) == ("github.com", "/owner/jobs.git")
    assert not got[urls[3]].supported and got[urls[3]].metadata_uri is None
    stripped = parse_repo_urls(df, "u", strip_blob=True).first()["metadata_uri"]
    assert stripped == "https://raw.githubusercontent.com/owner/jobs/main/dataset.json"


def test_text_columns(spark):
    ids = {"Été à Zürich": "ete-a-zurich", "Straße_1,000": "strasse-1000", "  a--b  ": "a-b", "Œuvre d'art": "oeuvre-d-art"}
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    assert {r.id: r.slug for r in slug_index(df).collect()} == ids
    paths = {"a.csv": "csv", "a.b/c.json": "json", "noext": "noext", "averylongname": "", "x.longextens": ""}
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.path: r.format for r in with_format(df).collect()} == paths
    urls = legacy_urls(spark.createDataFrame([("o/n", "d/x.csv")], "repository string, path string"))
    assert urls.first()["url"] == "https://raw.githubusercontent.com/o/n/master/d/x.csv"


def test_folders(spark):
    files = ["a/b/x.csv", "a/b/y.csv", ".git/objects/z", "a/.git/config", "a/.git/objects/q", "top.csv", "a/.dataset/m", "c/x"]
    df = spark.createDataFrame([(f,) for f in files], "path string")
    assert sorted(r.folder for r in list_folders(df).collect()) == ["a", "a/.git/objects", "a/b", "c"]


def test_pages(catalog):
    short = {r.id: r.page for r in render_pages(catalog, "short").collect()}
    assert short["git-jobs"] == '---\ntitle: "jobs"\ndescription: "listings"\nkeywords:\n  - "a"\n  - "b"\ncategory: work\n---\n  '
    assert short[""] == '---\ntitle: ""\n---\n  '
    full = {r.id: r.page for r in render_pages(catalog).collect()}
    body = full["git-jobs"].removeprefix("---\n").removesuffix("\n---\n  ")
    assert json.loads(body) == {**JOBS, "title": "jobs"}
    with pytest.raises(ValueError):
        render_pages(catalog, "loud")
