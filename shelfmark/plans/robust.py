"""Queries on inputs as they come: broken documents, nested values, shuffled columns, long lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import infer, lookup, mutate, search, shape, validate
from ..session import fresh_path
from ..sinks.catalogs import write_catalog_json
from ..sinks.pages import write_pages
from ..sources.catalogs import read_catalog_lines
from ..sources.tables import read_delimited, read_resource
from .registry import query
from .views import spread, table, tag, text


@query(
    "catalog_rejects",
    """
SELECT event_type, event_type NOT IN ('error', 'view') AS good,
       CASE event_type WHEN 'view' THEN 'not valid JSON' WHEN 'error' THEN 'not a JSON object' END AS reason, count(*) AS n
FROM events GROUP BY ALL""",
)
def catalog_rejects(spark, folder):
    """Events as lines of a catalog: views are cut off, errors are a bare text, the rest is a document."""
    e = F.col("event_type")
    doc = F.to_json(F.struct(tag("event-", "event_id").alias("id"), e.alias("name")))
    line = F.when(e == "view", F.concat(F.lit('{"view": '), "props")).when(e == "error", F.lit('"error"')).otherwise(doc)
    path = fresh_path(spark, "mixed")
    table(spark, folder, "events").select(line.alias("value")).write.text(path)
    good, bad = read_catalog_lines(spark, path, with_rejects=True)
    kind = F.when(F.col("body").startswith('"'), "error").otherwise("view")
    return (
        good.select(F.col("name").alias("event_type"), F.lit(True).alias("good"), F.lit(None).cast("string").alias("reason"))
        .unionByName(bad.select(kind.alias("event_type"), F.lit(False).alias("good"), "reason"))
        .groupBy("event_type", "good", "reason")
        .agg(F.count("*").alias("n"))
    )


@query(
    "search_nested_values",
    """
SELECT p_partkey AS pos, CASE WHEN lower(p_type) = 'promo' THEN 100::DOUBLE ELSE 0::DOUBLE END AS score
FROM part""",
)
def search_nested_values(spark, folder):
    """Part types as objects in names, and lists of objects in tags, of all parts."""
    p = spread(table(spark, folder, "part").select("p_partkey", "p_type"))
    other = F.when(F.col("p_type") == "PROMO", F.lower("p_type")).otherwise("0")
    nested = F.to_json(F.struct(F.struct(other.alias("en")).alias("name"), F.array(F.struct(F.lit("0").alias("label"))).alias("tags")))
    catalog = shape.normalize(p.select(F.col("p_partkey").alias("pos"), F.parse_json(nested).alias("raw")))
    return search.search_score(catalog, "promo", keys=("name", "tags")).select("pos", "score")


@query(
    "search_fields_nested",
    """
SELECT p_partkey AS pos, 'name__en' AS key, p_name AS value FROM part
UNION ALL SELECT p_partkey, 'tags__0__label', p_brand FROM part
UNION ALL SELECT p_partkey, 'tags__1__label', p_type FROM part""",
)
def search_fields_nested(spark, folder):
    p = table(spark, folder, "part")
    label = lambda c: F.struct(F.col(c).alias("label"))
    doc = F.to_json(F.struct(F.struct(F.col("p_name").alias("en")).alias("name"), F.array(label("p_brand"), label("p_type")).alias("tags")))
    catalog = shape.normalize(p.select(F.col("p_partkey").alias("pos"), F.parse_json(doc).alias("raw")))
    return lookup.search_fields(catalog, ("name", "tags")).select("pos", "key", "value")


@query("read_resource_shuffled", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def resource_shuffled(spark, folder):
    """The file has the declared columns in another order, and one more."""
    path = fresh_path(spark, "csv")
    columns = ["o_orderpriority", "o_orderkey", "o_orderstatus", "o_totalprice"]
    table(spark, folder, "orders").select(columns).write.csv(path, header=True)
    kinds = {"o_orderkey": "integer", "o_totalprice": "number", "o_orderpriority": "string"}
    fields = [{"name": n, "type": k} for n, k in kinds.items()]
    return read_resource(spark, {"path": path, "schema": {"fields": fields}})


@query(
    "read_resource_corrupt",
    """
SELECT o_orderkey, CAST(NULL AS BIGINT) AS o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderkey || ',' || o_orderstatus END AS line
FROM orders""",
)
def resource_corrupt(spark, folder):
    """With several missing values the cells of misfit rows are kept, too."""
    path = fresh_path(spark, "csv")
    table(spark, folder, "orders").select("o_orderkey", "o_orderstatus").write.csv(path, header=True)
    fields = [{"name": "o_orderkey", "type": "integer"}, {"name": "o_orderstatus", "type": "integer"}]
    declared = {"path": path, "schema": {"fields": fields, "missingValues": ["", "F"]}}
    return read_resource(spark, declared, keep_corrupt=True).withColumnRenamed("_corrupt_record", "line")


@query("read_delimited_long_comments", "SELECT c_custkey, c_name FROM customer UNION ALL SELECT NULL, 'c_name'")
def delimited_long_comments(spark, folder):
    """Comments of 100,000 characters, and a line of data that looks like a header."""
    path = fresh_path(spark, "commented")
    c = table(spark, folder, "customer")
    times = F.when(F.col("c_custkey") % 100 == 0, 20_000).otherwise(1)
    long = F.concat(text("c_custkey"), F.lit(',"'), "c_name", F.lit('"# '), F.repeat(F.lit("x y, "), times))
    lines = c.select(F.col("c_custkey").alias("k"), long.alias("value"))
    first = spark.createDataFrame([(-2, "c_custkey,c_name# header"), (-1, ",c_name")], "k long, value string")
    lines.unionByName(first).repartitionByRange("k").sortWithinPartitions("k").select("value").write.text(path)
    leaf = {"path": path, "comment": "#"}
    return read_delimited(spark, leaf).select(F.col("c_custkey").cast("long").alias("c_custkey"), F.trim("c_name").alias("c_name"))


@query(
    "backfill_saved",
    """
SELECT d.doc_id AS pos, CASE WHEN d.lang = 'fr' THEN NULL ELSE 'quality-' || l.quality END AS profile, d.source AS extra
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def backfill_saved(spark, folder):
    """Filled packages are in the documents that are saved, beside keys that no column holds."""
    docs = table(spark, folder, "documents")
    uri = F.concat(F.lit("https://host.example.org/"), text("doc_id"))
    kind = F.when(F.col("lang") == "fr", "s3").otherwise("git")
    doc = F.to_json(F.struct(text("doc_id").alias("id"), kind.alias("source"), uri.alias("metadata_uri"), F.col("source").alias("extra")))
    catalog = shape.normalize(docs.select(F.col("doc_id").alias("pos"), F.parse_json(doc).alias("raw")))
    package = F.from_json(F.to_json(F.struct(tag("quality-", "quality").alias("profile"))), catalog.schema["datapackage"].dataType)
    fetched = table(spark, folder, "labels").select(uri.alias("metadata_uri"), package.alias("datapackage"))
    path = fresh_path(spark, "filled")
    write_catalog_json(mutate.backfill(catalog, fetched), path)
    return read_catalog_lines(spark, path).select(
        F.col("id").cast("long").alias("pos"), F.col("datapackage.profile").alias("profile"), F.try_variant_get("raw", "$.extra", "string").alias("extra")
    )


@query(
    "validate_catalog",
    """
SELECT 'path' AS "check", CASE WHEN p_size % 5 = 0 THEN 'error' ELSE 'success' END AS status, count(*) AS n FROM part GROUP BY 1, 2
UNION ALL SELECT 'format', 'success', count(*) FROM part
UNION ALL SELECT 'description', CASE WHEN p_type = 'PROMO' THEN 'warning' ELSE 'success' END, count(*) FROM part GROUP BY 2
UNION ALL SELECT 'size', CASE WHEN p_size = 0 THEN 'warning' ELSE 'success' END, count(*) FROM part GROUP BY 2
UNION ALL SELECT 'fields', 'warning', count(*) FROM part""",
)
def validate_catalog(spark, folder):
    """Leaves listed in the documents of a catalog, checked and rolled up."""
    p = spread(table(spark, folder, "part"))
    leaf = F.struct(
        F.col("p_name").alias("name"),
        F.when(F.col("p_type") != "PROMO", F.col("p_type")).alias("description"),
        F.concat(F.lit("dataset/"), text("p_partkey"), F.lit(".csv")).alias("path"),
        F.lit("csv").alias("format"),
        F.col("p_size").alias("size"),
    )
    doc = F.to_json(F.struct(tag("part-", "p_partkey").alias("id"), F.array(leaf).alias("data")))
    catalog = shape.normalize(p.select(F.col("p_partkey").alias("pos"), F.parse_json(doc).alias("raw")))
    there = p.filter("p_size % 5 <> 0").select(
        F.concat(tag("part-", "p_partkey"), F.lit("/dataset/"), text("p_partkey"), F.lit(".csv")).alias("path")
    )
    return validate.roll_up(validate.validate_catalog(catalog, there))


@query(
    "infer_resources_wide",
    """
WITH files AS (
  SELECT 'supplier-' || s_suppkey AS name, s_suppkey % 40 AS extra FROM supplier WHERE s_suppkey % 10 <> 7)
SELECT 'data' AS dataset_id, row_number() OVER (ORDER BY name || '.csv') - 1 AS pos, name, name || '.csv' AS path, 'csv' AS format,
       'text/csv' AS mediatype, 'utf-8' AS encoding, 'tabular-data-resource' AS profile, '' AS missing,
       'key:integer bal:number' || coalesce(array_to_string(list_transform(range(0, extra), lambda i: ' x' || i || ':string'), ''), '') AS fields
FROM files""",
)
def infer_resources_wide(spark, folder):
    """One file per supplier, of 2 to 41 columns; names that readers leave out are left out."""
    s = table(spark, folder, "supplier")
    extra = F.col("s_suppkey") % 40
    more = F.when(extra > 0, F.sequence(F.lit(0), extra.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    page = F.concat(
        F.lit("key,bal"), F.array_join(F.transform(more, lambda i: F.concat(F.lit(",x"), i)), ""), F.lit("\n"),
        text("s_suppkey"), F.lit(","), text("s_acctbal"), F.array_join(F.transform(more, lambda i: F.lit(",é")), ""), F.lit("\n"),
    )
    slug = F.concat(F.when(F.col("s_suppkey") % 10 == 7, "_").otherwise(""), tag("supplier-", "s_suppkey"))
    root = fresh_path(spark, "wide")
    write_pages(s.select(slug.alias("slug"), text("s_suppkey").alias("id"), page.alias("page")), f"{root}/data", extension=".csv")
    found = infer.infer_resources(spark, root)
    fields = F.array_join(F.transform("schema.fields", lambda f: F.concat(f["name"], F.lit(":"), f["type"])), " ")
    return found.select(
        *[c for c in found.columns if c != "schema"], F.array_join("schema.missingValues", "|").alias("missing"), fields.alias("fields")
    )
