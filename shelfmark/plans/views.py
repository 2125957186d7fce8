"""Catalogs, leaves and listings derived from the benchmark tables.

Each view is given twice: as a DataFrame, and as a SQL common table expression for
the comparison. Views use whole tables and whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan evened out: a row group is read by one task, however many splits its file has.

    For per-row work that costs more than moving the row, such as scoring texts or
    parsing descriptors. A task gets about as many rows as cores or splits give it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(4 * cores, df.rdd.getNumPartitions()))


def text(col: str) -> Column:
    return F.col(col).cast("string")


def tag(prefix: str, col: str) -> Column:
    return F.concat(F.lit(prefix), text(col))


def whole(col: str) -> Column:
    return F.floor(col).cast("long")


# ---- parts as datasets ---------------------------------------------------------

PARTS = """
parts AS (
  SELECT p_partkey AS pos, 'part-' || p_partkey AS id, p_name AS name,
         p_brand || ' ' || p_type AS description,
         lower(p_type) || '/' || replace(p_name, ' ', '-') AS repository,
         CASE p_type WHEN 'PROMO' THEN 's3' WHEN 'ECONOMY' THEN 'disk' ELSE 'git' END AS source,
         CASE WHEN p_type = 'PROMO'
              THEN 's3://promo/' || p_partkey || CASE WHEN p_size > 25 THEN '/' ELSE '' END
              ELSE 'https://github.com/' || lower(p_type) || '/' || replace(p_name, ' ', '-')
                   || CASE WHEN p_size > 25 THEN '.git' ELSE '' END END AS uri,
         'https://host.example.org/' || p_partkey || '/main/dataset.json' AS metadata_uri,
         p_type AS category, p_brand, p_type, p_size
  FROM part)
"""


def parts(spark: SparkSession, folder: str) -> DataFrame:
    p = spread(table(spark, folder, "part"))
    repository = F.concat(F.lower("p_type"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")))
    late = F.col("p_size") > 25
    return p.select(
        F.col("p_partkey").alias("pos"),
        tag("part-", "p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.concat("p_brand", F.lit(" "), "p_type").alias("description"),
        repository.alias("repository"),
        F.when(F.col("p_type") == "PROMO", "s3")
        .when(F.col("p_type") == "ECONOMY", "disk")
        .otherwise("git")
        .alias("source"),
        F.when(
            F.col("p_type") == "PROMO",
            F.concat(F.lit("s3://promo/"), text("p_partkey"), F.when(late, "/").otherwise("")),
        )
        .otherwise(
            F.concat(F.lit("https://github.com/"), repository, F.when(late, ".git").otherwise(""))
        )
        .alias("uri"),
        F.concat(
            F.lit("https://host.example.org/"), text("p_partkey"), F.lit("/main/dataset.json")
        ).alias("metadata_uri"),
        F.col("p_type").alias("category"),
        F.array("p_brand", "p_type").alias("tags"),
    )


def with_raw(df: DataFrame, *cols: str) -> DataFrame:
    """Add ``raw``: the named columns as one document."""
    return df.withColumn("raw", F.parse_json(F.to_json(F.struct(*cols))))


# ---- documents as datasets, the whole text as description ----------------------

DOCS = """
docs AS (
  SELECT doc_id AS pos, source || '-' || doc_id AS id, lang || ' text ' || source AS name,
         text AS description, lang, source AS origin
  FROM documents)
"""


def docs(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents")).select(
        F.col("doc_id").alias("pos"),
        F.concat_ws("-", "source", text("doc_id")).alias("id"),
        F.concat_ws(" ", "lang", F.lit("text"), "source").alias("name"),
        F.col("text").alias("description"),
        F.array("lang", "source").alias("tags"),
    )


# ---- orders as datasets with nested resources ----------------------------------

# every order has 0, 2 or 3 resources, by its status
ORDER_RESOURCES = """
order_sets AS (
  SELECT o_orderkey AS pos, 'order-' || o_orderkey AS id,
         'order of customer ' || o_custkey AS name, o_orderstatus AS status, o_orderpriority AS priority,
         CASE WHEN o_orderstatus = 'F' THEN 's3' ELSE 'git' END AS source,
         'https://host.example.org/' || o_custkey || '/main/dataset.json' AS metadata_uri
  FROM orders),
order_resources AS (
  SELECT o.id AS dataset_id, CAST(r.pos AS BIGINT) AS pos, r.name || CASE WHEN r.pos = 0 THEN o.priority ELSE '' END AS name,
         'dataset/' || r.name || '-' || o.pos || '.' || r.format AS path, r.format AS format, o.source, o.metadata_uri, o.pos AS order_key
  FROM order_sets o
  JOIN (VALUES (0, 'items', 'csv'), (1, 'notes', 'csv'), (2, 'trace', 'json')) r(pos, name, format)
    ON r.pos < CASE o.status WHEN 'F' THEN 0 WHEN 'O' THEN 2 ELSE 3 END),
order_fields AS (
  SELECT r.dataset_id, r.pos AS resource_pos, r.name AS resource, CAST(f.pos AS BIGINT) AS field_pos,
         f.name AS field, f.type AS type, 'default' AS format
  FROM order_resources r
  JOIN (VALUES (0, 0, 'Line / No', 'integer'), (0, 1, 'price', 'number'), (0, 2, 'paid', 'boolean'),
               (1, 0, 'note', 'string')) f(resource_pos, pos, name, type)
    ON f.resource_pos = r.pos)
"""


def _resource(name: Column, path: str, kind: str, fields: list[tuple[str, str]]) -> Column:
    declared = [
        F.struct(F.lit(n).alias("name"), F.lit(t).alias("type"), F.lit("default").alias("format"))
        for n, t in fields
    ]
    empty = F.array().cast("array<struct<name:string,type:string,format:string>>")
    return F.struct(
        name.alias("name"),
        F.concat(F.lit(f"dataset/{path}-"), text("o_orderkey"), F.lit(f".{kind}")).alias("path"),
        F.lit(kind).alias("format"),
        F.struct(
            (F.array(*declared) if declared else empty).alias("fields"),
            F.array(F.lit("")).alias("missingValues"),
        ).alias("schema"),
    )


def order_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(pos, raw): one descriptor per order."""
    resources = F.array(
        _resource(
            F.concat(F.lit("items"), "o_orderpriority"),
            "items",
            "csv",
            [("Line / No", "integer"), ("price", "number"), ("paid", "boolean")],
        ),
        _resource(F.lit("notes"), "notes", "csv", [("note", "string")]),
        _resource(F.lit("trace"), "trace", "json", []),
    )
    n = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    doc = F.struct(
        tag("order-", "o_orderkey").alias("id"),
        tag("order of customer ", "o_custkey").alias("name"),
        F.when(F.col("o_orderstatus") == "F", "s3").otherwise("git").alias("source"),
        F.concat(
            F.lit("https://host.example.org/"), text("o_custkey"), F.lit("/main/dataset.json")
        ).alias("metadata_uri"),
        F.struct(
            F.lit("tabular-data-package").alias("profile"),
            F.slice(resources, F.lit(1), n).alias("resources"),
        ).alias("datapackage"),
    )
    return spread(table(spark, folder, "orders")).select(
        F.col("o_orderkey").alias("pos"), F.parse_json(F.to_json(doc)).alias("raw")
    )


# ---- orders as leaves, lineitems as file listing -------------------------------

LEAVES = """
leaves AS (
  SELECT 'customer-' || o_custkey AS dataset_id, o_orderkey AS pos,
         CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'dataset/' || o_orderkey || '.csv' END AS path,
         CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '' ELSE 'csv' END AS format,
         CASE o_orderpriority WHEN '1-URGENT' THEN NULL WHEN '2-HIGH' THEN '' ELSE 'order ' || o_orderkey END AS description,
         CASE WHEN o_totalprice > 300000 THEN 0 WHEN o_totalprice > 200000 THEN NULL
              ELSE CAST(floor(o_totalprice) AS BIGINT) END AS size,
         o_orderstatus AS s, o_orderpriority AS p
  FROM orders),
listing AS (SELECT DISTINCT 'dataset/' || l_orderkey || '.csv' AS path FROM lineitem WHERE l_returnflag = 'R'),
counts AS (
  SELECT *, CASE WHEN p = '5-LOW' THEN 0 ELSE 2 END AS n,
         CASE WHEN p = '5-LOW' THEN 0 WHEN s = 'F' THEN 1 ELSE 0 END AS names,
         CASE WHEN p = '5-LOW' THEN 0 WHEN s = 'F' THEN 2 WHEN s = 'P' THEN 1 ELSE 0 END AS texts
  FROM leaves)
"""


def leaves(spark: SparkSession, folder: str) -> DataFrame:
    """Leaves with every kind of gap: path by status, the rest by priority and price."""
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")

    def field(name: Column, description: Column) -> Column:
        return F.struct(name.alias("name"), description.alias("description"))

    second = F.when(s == "F", F.lit(None).cast("string")).otherwise("b")
    fields = F.array(
        field(F.lit("a"), F.when(s == "O", "first").otherwise("")),
        field(second, F.when(s == "F", F.lit(None).cast("string")).otherwise("second")),
    )
    return table(spark, folder, "orders").select(
        tag("customer-", "o_custkey").alias("dataset_id"),
        F.col("o_orderkey").alias("pos"),
        F.when(s == "P", "").otherwise(F.concat(F.lit("dataset/"), text("o_orderkey"), F.lit(".csv"))).alias("path"),
        F.when(p == "4-NOT SPECIFIED", "").otherwise("csv").alias("format"),
        F.when(p == "1-URGENT", F.lit(None).cast("string"))
        .when(p == "2-HIGH", "")
        .otherwise(tag("order ", "o_orderkey"))
        .alias("description"),
        F.when(F.col("o_totalprice") > 300000, F.lit(0))
        .when(F.col("o_totalprice") > 200000, F.lit(None))
        .otherwise(whole("o_totalprice"))
        .cast("long")
        .alias("size"),
        F.when(p != "5-LOW", fields).alias("fields"),
    )


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of the orders with a returned line; unique."""
    return (
        table(spark, folder, "lineitem")
        .filter(F.col("l_returnflag") == "R")
        .select(F.concat(F.lit("dataset/"), text("l_orderkey"), F.lit(".csv")).alias("path"))
        .distinct()
    )
