"""Queries on inference and assembly of descriptors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import infer, locate, mutate, shape
from ..operators.position import dense_position
from ..session import fresh_path, stage
from ..sinks.catalogs import write_catalog_json
from ..sources.catalogs import read_catalog_lines
from .registry import query
from .views import spread, table, tag, text, whole

LINEITEM = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
)

_INTEGER, _NUMBER = infer.PATTERNS["integer"], infer.PATTERNS["number"]
_DATE = r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$"
_STAMP = r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])[ T]([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?$"


def _votes(cells: str, confidence: float) -> str:
    return f"""
WITH cells AS ({cells}),
votes AS (
  SELECT name AS "column", count(*) AS n, count(*) FILTER (cell IS NULL OR cell = '') AS n_missing,
         count(*) FILTER (regexp_matches(cell, '{_INTEGER}')) AS n_integer,
         count(*) FILTER (regexp_matches(cell, '{_INTEGER}') OR regexp_matches(cell, '{_NUMBER}')) AS n_number,
         count(*) FILTER (lower(cell) IN ('true', 'false')) AS n_boolean,
         count(*) FILTER (regexp_matches(cell, '{_DATE}')) AS n_date,
         count(*) FILTER (regexp_matches(cell, '{_STAMP}')) AS n_datetime
  FROM cells GROUP BY name),
need AS (SELECT *, {confidence} * (n - n_missing) AS k FROM votes)
SELECT * EXCLUDE (k), CASE WHEN n_integer >= k AND n_integer > 0 THEN 'integer' WHEN n_number >= k AND n_number > 0 THEN 'number'
  WHEN n_boolean >= k AND n_boolean > 0 THEN 'boolean' WHEN n_date >= k AND n_date > 0 THEN 'date'
  WHEN n_datetime >= k AND n_datetime > 0 THEN 'datetime' ELSE 'string' END AS type FROM need"""


def _cells(table_name: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS name, CAST({sql} AS VARCHAR) AS cell FROM {table_name}" for name, sql in columns.items()
    )


@query("infer_types", _votes(_cells("lineitem", {c: c for c in LINEITEM}), 0.75))
def infer_types(spark, folder):
    rows = spread(table(spark, folder, "lineitem"))
    return infer.infer_types(rows.select(*[text(c).alias(c) for c in LINEITEM]))


_MIXED = {
    "day": "strftime(o_orderdate, '%Y-%m-%d')",
    "flag": "CASE o_orderstatus WHEN 'F' THEN 'true' WHEN 'O' THEN 'FALSE' ELSE '' END",
    "mixed": "CASE WHEN o_orderpriority = '5-LOW' THEN 'low' ELSE CAST(o_orderkey AS VARCHAR) END",
    "rare": "CASE WHEN o_orderpriority = '5-LOW' THEN CAST(o_orderkey AS VARCHAR) ELSE o_orderpriority END",
    "gone": "CAST(NULL AS VARCHAR)",
}


@query("infer_types_mixed", _votes(_cells("orders", _MIXED), 0.75))
def infer_types_mixed(spark, folder):
    """Dates, booleans, and columns on both sides of the confidence share."""
    low, status = F.col("o_orderpriority") == "5-LOW", F.col("o_orderstatus")
    rows = table(spark, folder, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.when(status == "F", "true").when(status == "O", "FALSE").otherwise("").alias("flag"),
        F.when(low, "low").otherwise(text("o_orderkey")).alias("mixed"),
        F.when(low, text("o_orderkey")).otherwise(F.col("o_orderpriority")).alias("rare"),
        F.lit(None).cast("string").alias("gone"),
    )
    return infer.infer_types(rows)


@query(
    "declared_cast_failures",
    f"""
WITH cells AS (
  SELECT 'o_orderkey' AS name, 'integer' AS type, CAST(o_orderkey AS VARCHAR) AS cell, '{_INTEGER}' AS form FROM orders
  UNION ALL SELECT 'o_totalprice', 'integer', CAST(o_totalprice AS VARCHAR), '{_INTEGER}' FROM orders
  UNION ALL SELECT 'o_orderstatus', 'boolean', o_orderstatus, '^(?i:true|false)$' FROM orders
  UNION ALL SELECT 'o_orderdate', 'datetime', CAST(o_orderdate AS VARCHAR), '{_STAMP}' FROM orders
  UNION ALL SELECT 'o_orderpriority', 'string', o_orderpriority, '' FROM orders)
SELECT name AS "column", type, count(*) AS n, count(*) FILTER (cell IN ('', 'F')) AS n_missing,
       count(*) FILTER (cell NOT IN ('', 'F') AND NOT regexp_matches(cell, form)) AS n_failed
FROM cells GROUP BY name, type""",
)
def declared_cast_failures(spark, folder):
    """Orders as text under types that partly do not fit; the status F counts as missing."""
    declared = {
        "o_orderkey": "integer",
        "o_totalprice": "integer",
        "o_orderstatus": "boolean",
        "o_orderdate": "datetime",
        "o_orderpriority": "string",
    }
    rows = table(spark, folder, "orders").select(*[text(c).alias(c) for c in declared])
    fields = [{"name": n, "type": t} for n, t in declared.items()]
    return infer.cast_failures(rows, fields, ["", "F"])


@query(
    "build_leaves",
    """
SELECT coalesce(CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent ' || o_orderkey END, '') AS name,
       coalesce(CASE WHEN o_orderpriority = '1-URGENT' THEN 'by ' || o_custkey END, '') AS description,
       'dataset/' || o_orderkey || CASE o_orderstatus WHEN 'F' THEN '.csv' WHEN 'O' THEN '.json' ELSE '.longextension' END AS path,
       CASE o_orderstatus WHEN 'F' THEN 'csv' WHEN 'O' THEN 'json' ELSE '' END AS format,
       CAST(floor(o_totalprice) AS BIGINT) AS size, '' AS updated_at,
       CASE o_orderstatus WHEN 'F' THEN 'key|' || o_orderpriority ELSE '|' END AS fields
FROM orders""",
)
def build_leaves(spark, folder):
    orders, s = table(spark, folder, "orders"), F.col("o_orderstatus")
    ending = F.when(s == "F", ".csv").when(s == "O", ".json").otherwise(".longextension")
    path = F.concat(F.lit("dataset/"), text("o_orderkey"), ending).alias("path")

    def field(name):
        return F.struct(name.alias("name"), F.lit("").alias("description"))

    files = orders.select(path, whole("o_totalprice").alias("size"))
    headers = orders.filter(s == "F").select(
        path, F.array(field(F.lit("key")), field(F.col("o_orderpriority"))).alias("fields")
    )
    user = orders.filter(F.col("o_orderpriority") == "1-URGENT").select(
        path,
        tag("urgent ", "o_orderkey").alias("name"),
        tag("by ", "o_custkey").alias("description"),
        F.lit(None).cast("string").alias("updated_at"),
    )
    return infer.build_leaves(files, headers, user).withColumn(
        "fields", F.array_join(F.transform("fields", lambda f: f["name"]), "|")
    )


def _order_files(spark, folder):
    """Orders as the files of their customer, numbered by path on all executors."""
    none = F.lit(None).cast("string")
    files = table(spark, folder, "orders").select(
        tag("customer-", "o_custkey").alias("dataset_id"),
        F.col("o_orderpriority").alias("name"),
        F.concat(F.lit("dataset/"), text("o_orderkey"), F.lit(".csv")).alias("path"),
    )
    # what all files share is added behind the sort
    return dense_position(files, ["path"], by=["dataset_id"]).withColumns(
        {
            "format": F.lit("csv"),
            "mediatype": F.lit("text/csv"),
            "encoding": F.lit("utf-8"),
            "profile": F.lit("tabular-data-resource"),
            "schema": F.struct(
                F.array(F.struct(F.lit("key").alias("name"), F.lit("integer").alias("type"), none.alias("format"))).alias("fields"),
                F.array(F.lit("")).alias("missingValues"),
            ),
        }
    )


_FILES = """
files AS (
  SELECT 'customer-' || o_custkey AS dataset_id, 'dataset/' || o_orderkey || '.csv' AS path, o_orderpriority AS name,
         row_number() OVER (PARTITION BY o_custkey ORDER BY 'dataset/' || o_orderkey || '.csv') - 1 AS pos FROM orders)
"""


@query("dense_position", f"WITH {_FILES} SELECT dataset_id, path, pos FROM files")
def positions(spark, folder):
    return _order_files(spark, folder).select("dataset_id", "path", "pos")


def _described(spark, folder):
    basics = table(spark, folder, "customer").select(
        tag("customer-", "c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("description"),
        F.lit("git").alias("source"),
        F.concat(F.lit("https://github.com/owner/"), text("c_custkey"), F.lit(".git")).alias("uri"),
    )
    return infer.build_descriptors(basics, _order_files(spark, folder))


@query(
    "build_descriptors",
    f"""WITH {_FILES}
SELECT 'customer-' || c_custkey AS id, c_name AS name,
       'https://raw.githubusercontent.com/owner/' || c_custkey || '/main/dataset.json' AS metadata_uri,
       CAST(count(f.path) AS BIGINT) AS n_resources, coalesce(string_agg(f.path, ' ' ORDER BY f.pos), '') AS paths
FROM customer LEFT JOIN files f ON f.dataset_id = 'customer-' || c_custkey GROUP BY c_custkey, c_name""",
)
def build_descriptors(spark, folder):
    paths = F.transform("datapackage.resources", lambda r: r.path)
    return _described(spark, folder).select(
        "id",
        "name",
        "metadata_uri",
        F.coalesce(F.size(paths), F.lit(0)).cast("long").alias("n_resources"),
        F.coalesce(F.array_join(paths, " "), F.lit("")).alias("paths"),
    )


@query("build_descriptor_parts", f"WITH {_FILES} SELECT dataset_id, pos, path, name FROM files")
def build_descriptor_parts(spark, folder):
    """Descriptors unfolded again: nothing is lost."""
    return shape.explode_resources(_described(spark, folder)).select("dataset_id", "pos", "path", "name")


_SAVED = f"""WITH {_FILES},
ids AS (SELECT 'customer-' || c_custkey AS id, c_name AS name, c_custkey, row_number() OVER (ORDER BY 'customer-' || c_custkey) - 1 AS k FROM customer),
have AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS pos FROM ids WHERE c_custkey % 3 = 0),
fresh AS (SELECT *, (SELECT count(*) FROM have) + row_number() OVER (ORDER BY id) - 1 AS pos FROM ids WHERE c_custkey % 3 <> 0)
"""


@query(
    "create_register_save",
    _SAVED
    + """SELECT a.pos, a.id, a.name, 'git' AS source, 'https://raw.githubusercontent.com/owner/' || c_custkey || '/main/dataset.json' AS metadata_uri,
       coalesce(string_agg(f.path || ':' || f.name, ' ' ORDER BY f.pos), '') AS resources
FROM (SELECT * FROM have UNION ALL SELECT * FROM fresh) a LEFT JOIN files f ON f.dataset_id = a.id GROUP BY ALL""",
)
def create_register_save(spark, folder):
    """Descriptors are built, added to a catalog, saved as lines and read again."""
    # built once: for the sample of a sort, the sort, and the new rows; saving makes the documents
    built = stage(_described(spark, folder).drop("raw"), "built")
    old = F.expr("cast(substring(id, 10) AS long) % 3 = 0")
    have = dense_position(built.filter(old).drop("pos"), ["id"])
    merged, _ = mutate.add(have, built.filter(~old))
    path = fresh_path(spark, "registered")
    write_catalog_json(merged, path)
    # of the packages only what is asked for is taken out of the documents
    saved = F.try_variant_get("raw", "$.datapackage.resources", "array<struct<name string, path string>>")
    files = F.transform(saved, lambda r: F.concat(r["path"], F.lit(":"), r["name"]))
    return read_catalog_lines(spark, path).select(
        "pos", "id", "name", "source", "metadata_uri", F.coalesce(F.array_join(files, " "), F.lit("")).alias("resources")
    )


@query(
    "resolve_large",
    """SELECT o_orderkey AS pos, 'https://raw.githubusercontent.com/owner/' || o_orderpriority || '/main/dataset/' || o_orderkey || '.csv' AS location
FROM orders""",
)
def resolve_large(spark, folder):
    """Orders as files of five datasets, kept as a table; a third of them may be in one."""
    orders = table(spark, folder, "orders")
    files = orders.select(
        F.col("o_orderpriority").alias("dataset_id"),
        F.col("o_orderkey").alias("pos"),
        F.lit(None).cast("string").alias("name"),
        F.concat(F.lit("dataset/"), text("o_orderkey"), F.lit(".csv")).alias("path"),
    )
    uri = F.concat(F.lit("https://raw.githubusercontent.com/owner/"), "id", F.lit("/main/dataset.json"))
    catalog = orders.select(F.col("o_orderpriority").alias("id"), F.lit("git").alias("source")).distinct().withColumn("metadata_uri", uri)
    folders = table(spark, folder, "region").select(F.col("r_name").alias("id"))
    return locate.resolve_paths(catalog, folders, "/data", files).select("pos", "location")


@query(
    "dense_position_nulls",
    """SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS grp,
row_number() OVER (PARTITION BY nullif(o_orderpriority, '5-LOW') ORDER BY o_orderkey) - 1 AS pos FROM orders""",
)
def positions_of_nulls(spark, folder):
    """Rows with a null key are a group of their own."""
    rows = table(spark, folder, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("grp"))
    return dense_position(rows, ["o_orderkey"], by=["grp"])
