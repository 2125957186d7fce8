"""Queries that write files derived from the tables and read them back.

Files go to a new folder below the shared folder of the session.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import infer, lookup, shape, validate
from ..session import fresh_path
from ..sinks.catalogs import (
    create_catalog,
    export_catalog_dir,
    write_catalog,
    write_catalog_array,
    write_catalog_dir,
    write_catalog_json,
)
from ..sinks.materialize import materialize
from ..sinks.pages import render_pages, write_pages
from ..sources.catalogs import read_catalog, read_catalog_dir, read_catalog_json, read_catalog_lines
from ..sources.files import list_files, read_texts
from ..sources.tables import read_delimited, read_json_resource, read_resource
from .registry import query
from .views import PARTS, parts, table, tag, text, with_raw



def _suppliers(spark, folder, note="old"):
    s = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("pos"),
        tag("supplier-", "s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        F.lit(note).alias("description"),
    )
    return with_raw(s, "id", "name", "description")


_SUPPLIERS = """
suppliers AS (
  SELECT s_suppkey, 'supplier-' || s_suppkey AS id, s_name AS name,
         row_number() OVER (ORDER BY 'supplier-' || s_suppkey) - 1 AS pos, s_nationkey FROM supplier)
"""


@query("catalog_dir", f"WITH {_SUPPLIERS} SELECT pos, id, name, 'old' AS description FROM suppliers")
def catalog_dir(spark, folder):
    path = fresh_path(spark, "catalog-dir")
    create_catalog(_suppliers(spark, folder), path)
    return read_catalog_dir(spark, path).select("pos", "id", "name", "description")


@query(
    "catalog_dir_replaced",
    f"""WITH {_SUPPLIERS} SELECT id, CASE WHEN id IN ('supplier-3', 'supplier-7') THEN 'new' ELSE 'old' END AS description
FROM suppliers""",
)
def catalog_dir_replaced(spark, folder):
    path = fresh_path(spark, "catalog-dir")
    create_catalog(_suppliers(spark, folder), path)
    write_catalog_dir(_suppliers(spark, folder, "new"), path, ["supplier-3", "supplier-7"])
    return read_catalog_dir(spark, path).select("id", "description")


@query(
    "catalog_dir_exported",
    f"WITH {_SUPPLIERS} SELECT pos, id, name, CASE WHEN id = 'supplier-3' THEN 'new' ELSE 'old' END AS description FROM suppliers",
)
def catalog_dir_exported(spark, folder):
    path = fresh_path(spark, "catalog-dir")
    export_catalog_dir(_suppliers(spark, folder), path)
    export_catalog_dir(_suppliers(spark, folder, "new"), path, ["supplier-3"])
    return read_catalog_dir(spark, path).select("pos", "id", "name", "description")


@query("catalog_json", "SELECT s_suppkey AS pos, 'supplier-' || s_suppkey AS id, s_name AS name FROM supplier")
def catalog_json(spark, folder):
    path = fresh_path(spark, "catalog-json")
    write_catalog_array(_suppliers(spark, folder), path)
    return read_catalog_json(spark, path).select("pos", "id", "name")


@query("catalog_lines", f"WITH {PARTS} SELECT pos, id, name, p_brand || '|' || p_type AS tags FROM parts")
def catalog_lines(spark, folder):
    path = fresh_path(spark, "catalog-lines")
    write_catalog_json(with_raw(parts(spark, folder), "id", "name", "tags"), path)
    return read_catalog_lines(spark, path).select("pos", "id", "name", F.array_join("tags", "|").alias("tags"))


@query("catalog_table", f"WITH {PARTS} SELECT pos, id, name FROM parts WHERE id IN ('part-1', 'part-100')")
def catalog_table(spark, folder):
    path = fresh_path(spark, "catalog-table")
    write_catalog(with_raw(parts(spark, folder), "id", "name", "tags"), path)
    return lookup.by_ids(read_catalog(spark, path), ["part-1", "part-100"]).select("pos", "id", "name")


@query(
    "list_files",
    f"""WITH {_SUPPLIERS} SELECT id AS folder, id || '/dataset.json' AS path,
length('{{' || chr(10) || '    "description": "old",' || chr(10) || '    "id": "' || id || '",' || chr(10)
       || '    "name": "' || name || '"' || chr(10) || '}}') AS size FROM suppliers""",
)
def listed_files(spark, folder):
    path = fresh_path(spark, "catalog-dir")
    create_catalog(_suppliers(spark, folder), path)
    files = list_files(spark, path, glob="*.json")
    return files.select(F.split("path", "/")[0].alias("folder"), "path", "size")


@query(
    "list_folders",
    r"""
WITH files AS (SELECT regexp_replace(url, '^https?://', '') AS path FROM pages),
steps AS (SELECT DISTINCT string_split(regexp_extract(path, '^(.*)/[^/]*$', 1), '/') AS s FROM files),
folders AS (SELECT DISTINCT array_to_string(list_slice(s, 1, n), '/') AS folder, s[n] AS last
            FROM (SELECT s, unnest(range(1, len(s) + 1)) AS n FROM steps))
SELECT folder FROM folders WHERE last NOT IN ('.git', '.vscode', '.dataset', 'es') AND folder NOT LIKE '.%' AND folder <> ''""",
)
def listed_folders(spark, folder):
    """Web paths as files; the folder name of Spanish pages is ignored."""
    files = table(spark, folder, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path"))
    return lookup.list_folders(files, (*lookup.ignored_names(), "es"))


@query("read_resource", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def resource(spark, folder):
    path = fresh_path(spark, "csv")
    p = table(spark, folder, "part")
    p.write.csv(path, header=True)
    kinds = ["integer", "string", "string", "string", "integer", "number"]
    fields = [{"name": c, "type": k} for c, k in zip(p.columns, kinds)]
    declared = {"path": path, "encoding": "utf-8", "schema": {"fields": fields, "missingValues": [""]}}
    return read_resource(spark, declared).withColumn("p_size", F.col("p_size").cast("int"))


@query(
    "read_resource_missing",
    """SELECT o_orderkey, CASE WHEN o_orderstatus NOT IN ('F', 'P') THEN o_orderstatus END AS o_orderstatus,
o_totalprice FROM orders""",
)
def resource_missing(spark, folder):
    """Two statuses are declared as missing values."""
    path = fresh_path(spark, "csv")
    table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").write.csv(path, header=True)
    fields = [
        {"name": "o_orderkey", "type": "integer"},
        {"name": "o_orderstatus", "type": "string"},
        {"name": "o_totalprice", "type": "number"},
    ]
    return read_resource(spark, {"path": path, "schema": {"fields": fields, "missingValues": ["", "F", "P"]}})


@query(
    "read_resource_windows_1252",
    r"SELECT page_id, regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[^\x20-\x7e\xa0-\xff]', '', 'g') || '“…”' AS title FROM pages",
)
def resource_windows(spark, folder):
    """Titles and curly quotes in a charset that Spark itself does not read."""
    path = fresh_path(spark, "csv")
    title = F.regexp_replace(
        F.regexp_extract("html", "<title>([^<]*)</title>", 1), r"[^\x20-\x7e\xa0-\xff]", ""
    )
    # the quotes as the characters that ISO-8859-1 gives the bytes 93, 85 and 94
    rows = table(spark, folder, "pages").select("page_id", F.concat(title, F.lit("\x93\x85\x94")).alias("title"))
    rows.write.csv(path, header=True, encoding="ISO-8859-1")
    fields = [{"name": "page_id", "type": "integer"}, {"name": "title", "type": "string"}]
    return read_resource(spark, {"path": path, "encoding": "windows-1252", "schema": {"fields": fields}})


@query("read_delimited", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def delimited(spark, folder):
    path = fresh_path(spark, "delimited")
    table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority").write.csv(
        path, header=True, sep=";"
    )
    return read_delimited(spark, {"path": path, "seperator": ";"})


@query("read_delimited_comments", "SELECT o_orderkey, o_orderpriority || '#' AS note, o_totalprice FROM orders")
def delimited_comments(spark, folder):
    """Comment lines, comments after the data, and the mark inside quotes."""
    path = fresh_path(spark, "delimited")
    line = F.concat_ws(
        "|", text("o_orderkey"), F.concat(F.lit('"'), "o_orderpriority", F.lit('#"')), text("o_totalprice")
    )
    rows = table(spark, folder, "orders").select(F.concat(line, F.lit("# checked")).alias("value"))
    head = ["# orders", "o_orderkey|note|o_totalprice"]
    lines = F.when(
        F.col("value").startswith('0|"'), F.array(*[F.lit(h) for h in head], F.col("value"))
    ).otherwise(F.array("value"))
    rows.select(F.explode(lines).alias("value")).write.text(path)
    return read_delimited(spark, {"path": path, "seperator": "|", "comment": "#"})


@query("read_json_resource", "SELECT 'supplier-' || s_suppkey AS id, s_name AS name, 'old' AS description FROM supplier")
def json_resource(spark, folder):
    path = fresh_path(spark, "json")
    write_catalog_array(_suppliers(spark, folder), path)
    return read_json_resource(spark, {"path": path, "format": "JSON"}).select("id", "name", "description")


def _csv_tree(spark, folder):
    """<root>/<table>/data/*.csv for two tables.

    The first task of a write makes a file even if its split of the table has no row, and a
    header alone tells no types. Dealt by key, the first task has the smallest keys.
    """
    root = fresh_path(spark, "tree")
    for name, key in (("customer", "c_custkey"), ("supplier", "s_suppkey")):
        table(spark, folder, name).repartitionByRange(key).write.csv(f"{root}/{name}/data", header=True)
    return root


_FIELDS = {
    "customer": "c_custkey:integer|c_name:string|c_nationkey:integer|c_acctbal:number|c_mktsegment:string",
    "supplier": "s_suppkey:integer|s_name:string|s_nationkey:integer|s_acctbal:number",
}


@query(
    "csv_fields",
    " UNION ALL ".join(
        "SELECT DISTINCT '{0}' AS dataset_id, '{1}' AS fields FROM {0}".format(
            n, "|".join(f.split(":")[0] for f in fields.split("|"))
        )
        for n, fields in _FIELDS.items()
    ),
)
def csv_header_fields(spark, folder):
    files = list_files(spark, _csv_tree(spark, folder), glob="*.csv")
    fields = infer.csv_fields(files)
    return fields.select(
        F.split("path", "/")[0].alias("dataset_id"),
        F.array_join(F.transform("fields", lambda f: f["name"]), "|").alias("fields"),
    ).distinct()


@query(
    "infer_resources",
    " UNION ALL ".join(
        f"SELECT DISTINCT '{n}' AS dataset_id, 'utf-8' AS encoding, '{fields}' AS fields FROM {n}"
        for n, fields in _FIELDS.items()
    ),
)
def inferred_resources(spark, folder):
    found = infer.infer_resources(spark, _csv_tree(spark, folder))
    fields = F.transform("schema.fields", lambda f: F.concat_ws(":", f["name"], f["type"]))
    return found.select("dataset_id", "encoding", F.array_join(fields, "|").alias("fields")).distinct()


@query(
    "resource_failures",
    """
SELECT 'customer' AS dataset_id, 'c_acctbal' AS field, 'integer' AS type, count(*) AS n, 0 AS n_missing,
       count(*) AS n_failed FROM customer
UNION ALL SELECT 'customer', 'c_custkey', 'number', count(*), 0, 0 FROM customer
UNION ALL SELECT 'customer', 'c_name', 'string', count(*), 0, 0 FROM customer
UNION ALL SELECT 'supplier', 's_name', 'boolean', count(*), 0, count(*) FROM supplier
UNION ALL SELECT 'supplier', 's_nationkey', 'integer', count(*), 0, 0 FROM supplier""",
)
def failures_of_resources(spark, folder):
    """All files of two datasets against declared types that partly do not fit."""
    root = _csv_tree(spark, folder)
    kinds = {
        "customer": {"c_acctbal": "integer", "c_custkey": "number", "c_name": "string"},
        "supplier": {"s_name": "boolean", "s_nationkey": "integer"},
    }
    wrong = F.create_map(*[F.lit(x) for k in kinds.values() for kv in k.items() for x in kv])
    files = list_files(spark, root, glob="*.csv")
    steps = F.split("path", "/")
    declared = (
        infer.csv_fields(files)
        .select(
            steps[0].alias("dataset_id"),
            F.array_join(F.slice(steps, 2, 100), "/").alias("path"),
            F.explode("fields.name").alias("field"),
        )
        .withColumn("type", wrong[F.col("field")])
        .filter(F.col("type").isNotNull())
    )
    found = infer.resource_failures(spark, root, declared)
    return found.groupBy("dataset_id", "field", "type").agg(
        *[F.sum(c).alias(c) for c in ("n", "n_missing", "n_failed")]
    )


@query(
    "materialize",
    """SELECT 'customer' AS name, c_custkey AS key, c_acctbal AS balance FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier""",
)
def materialized(spark, folder):
    """A dataset of two data files, declared, located, read and saved as tables."""
    root = _csv_tree(spark, folder)
    doc = {
        n: ",".join(
            '{"name":"%s","type":"%s","format":"default"}' % tuple(f.split(":")) for f in fields.split("|")
        )
        for n, fields in _FIELDS.items()
    }
    resources = ",".join(
        f'{{"name":"{n}","path":"{n}/data","format":"csv","encoding":"utf-8","schema":{{"fields":[{d}],"missingValues":[""]}}}}'
        for n, d in doc.items()
    )
    base, _, name = root.rpartition("/")
    raw = f'{{"id":"{name}","source":"git","datapackage":{{"resources":[{resources}]}}}}'
    catalog = shape.normalize(
        spark.range(1).select(F.col("id").alias("pos"), F.parse_json(F.lit(raw)).alias("raw"))
    )
    dest = fresh_path(spark, "tables")
    here = catalog.select("id")
    written = materialize(catalog, [name], dest, here, base)
    customer, supplier = (spark.read.parquet(p) for p in written)
    return customer.select(
        F.lit("customer").alias("name"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance")
    ).unionByName(
        supplier.select(
            F.lit("supplier").alias("name"), F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance")
        )
    )


@query("write_pages", "SELECT replace(p_name, ' ', '-') AS slug, count(*) AS n FROM part GROUP BY 1")
def written_pages(spark, folder):
    """Pages that share a slug are all kept."""
    path = fresh_path(spark, "pages")
    shared = parts(spark, folder).withColumn("id", F.col("name"))
    write_pages(render_pages(shared, "short"), path)
    files = read_texts(list_files(spark, path, glob="*.md")).select(
        F.regexp_extract("path", "^(.*?)(--[0-9]+)?[.]md$", 1).alias("slug"),
        F.regexp_count("value", F.lit('(?s)^---\ntitle: ".*\n---\n  $')).alias("whole"),
    )
    return files.groupBy("slug").agg(F.sum("whole").alias("n"))


@query(
    "validate_descriptors",
    f"""WITH {_SUPPLIERS} SELECT id AS folder, CASE WHEN s_nationkey < 10 THEN 'error' ELSE 'success' END AS status,
CASE WHEN s_nationkey < 5 THEN 'descriptor is missing' WHEN s_nationkey < 10 THEN 'descriptor is not valid JSON'
     ELSE 'descriptor exists' END AS message FROM suppliers""",
)
def validated_descriptors(spark, folder):
    """Suppliers of the first nations have no descriptor, of the next ones a broken one."""
    s = table(spark, folder, "supplier").select(tag("supplier-", "s_suppkey").alias("folder"), "s_nationkey")
    descriptors = s.filter(F.col("s_nationkey") >= 5).select(
        "folder", F.when(F.col("s_nationkey") < 10, "{").otherwise('{"id":"x"}').alias("value")
    )
    return validate.validate_descriptors(s.select("folder"), descriptors)
