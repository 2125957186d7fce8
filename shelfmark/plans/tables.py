"""Queries on data files: many in one job, records cut by blocks, repeated names, JSON under a declared schema, repeated fetches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import mutate, shape
from ..session import fresh_path
from ..sinks.catalogs import write_catalog_array
from ..sinks.materialize import materialize_many
from ..sources.catalogs import read_catalog_json_blocks
from ..sources.tables import read_delimited, read_resource
from .registry import query
from .views import table, tag, text


@query(
    "materialize_many",
    """
SELECT 'customer' AS dataset_id, c_nationkey AS nation, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer GROUP BY 2
UNION ALL SELECT 'supplier', s_nationkey, count(*), CAST(sum(s_suppkey) AS BIGINT) FROM supplier GROUP BY 2""",
)
def materialized_many(spark, folder):
    """Two datasets with a data file for each nation; in those of odd nations the columns stand the other way."""
    root = fresh_path(spark, "nations")
    documents = []
    for name, keys in (("customer", ("c_custkey", "c_nationkey", "c_name")), ("supplier", ("s_suppkey", "s_nationkey", "s_name"))):
        rows = table(spark, folder, name).withColumn("nation", F.col(keys[1]))
        odd = F.col("nation") % 2 == 1
        rows.where(~odd).select(*keys, "nation").write.partitionBy("nation").csv(f"{root}/{name}", header=True)
        rows.where(odd).select(*reversed(keys), "nation").write.partitionBy("nation").mode("append").csv(f"{root}/{name}", header=True)
        fields = F.array(*[F.struct(F.lit(k).alias("name"), F.lit("string" if k.endswith("name") else "integer").alias("type")) for k in keys])
        one = F.struct(
            tag("nation-", "nation").alias("name"), tag("nation=", "nation").alias("path"), F.lit("csv").alias("format"),
            F.struct(fields.alias("fields")).alias("schema"),
        )
        package = rows.select("nation").distinct().agg(F.struct(F.collect_list(one).alias("resources")).alias("datapackage"))  # 25 at most
        documents.append(package.select(F.to_json(F.struct(F.lit(name).alias("id"), "datapackage")).alias("doc")))
    both = reduce(DataFrame.union, documents)
    catalog = shape.normalize(both.select(F.monotonically_increasing_id().alias("pos"), F.parse_json("doc").alias("raw")))
    dest = fresh_path(spark, "tables")
    manifest = materialize_many(catalog, None, dest, catalog.select("id"), root)
    saved = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").option("mergeSchema", True)
    parts = []
    for name, key, nation in (("customer", "c_custkey", "c_nationkey"), ("supplier", "s_suppkey", "s_nationkey")):
        rows = saved.parquet(f"{dest}/{name}").select(
            F.lit(name).alias("dataset_id"), F.col(nation).alias("nation"), F.col(key).alias("key"),
            F.regexp_extract("_metadata.file_path", "/(nation-[0-9]+)/", 1).alias("name"),
        )
        parts.append(rows)
    found = parts[0].unionByName(parts[1]).join(manifest.select("dataset_id", "name"), ["dataset_id", "name"])
    return found.where(F.col("name") == tag("nation-", "nation")).groupBy("dataset_id", "nation").agg(
        F.count("*").alias("n"), F.sum("key").alias("keys")
    )


@query("read_resource_repeated_header", "SELECT o_orderkey, o_custkey AS key FROM orders")
def resource_repeated_header(spark, folder):
    """The header has the name twice; the first column of the name counts, and declared fields go by name."""
    path = fresh_path(spark, "csv")
    o = table(spark, folder, "orders")
    lines = o.select(F.concat_ws(",", text("o_custkey"), text("o_orderkey"), F.lit("other")).alias("key,o_orderkey,key"))
    # no quotes around the one column: its name is the header line
    lines.write.csv(path, header=True, sep="\u0001", quote="")
    fields = [{"name": n, "type": "integer"} for n in ("o_orderkey", "key")]
    return read_resource(spark, {"path": path, "schema": {"fields": fields}})


@query(
    "read_resource_json_missing",
    """
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_custkey END AS o_custkey,
       CASE WHEN o_orderpriority <> 'LOW' THEN o_orderpriority END AS o_orderpriority,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS o_totalprice, o_orderstatus = 'P' AS misfit FROM orders""",
)
def resource_json_missing(spark, folder):
    """Orders as JSON with numbers as texts, missing values, and prices that are none."""
    path = fresh_path(spark, "json")
    key = F.when(F.col("o_orderstatus") == "F", "n/a").otherwise(text("o_custkey"))
    price = F.when(F.col("o_orderstatus") == "P", "on request").otherwise(text("o_totalprice"))
    rows = table(spark, folder, "orders").select("o_orderkey", key.alias("o_custkey"), price.alias("o_totalprice"), "o_orderpriority")
    write_catalog_array(rows.select(F.col("o_orderkey").alias("pos"), F.to_variant_object(F.struct("*")).alias("raw")), path)
    kinds = {"o_orderkey": "integer", "o_custkey": "integer", "o_orderpriority": "string", "o_totalprice": "number"}
    schema = {"fields": [{"name": n, "type": k} for n, k in kinds.items()], "missingValues": ["", "n/a", "LOW"]}
    found = read_resource(spark, {"path": path, "format": "json", "schema": schema}, keep_corrupt=True)
    return found.select(*kinds, F.col("_corrupt_record").isNotNull().alias("misfit"))


@query(
    "backfill_repeated",
    """
SELECT o_orderkey AS pos, CASE WHEN n > 0 THEN 'filled' ELSE 'missing' END AS backfill_status, least AS profile
FROM orders LEFT JOIN (SELECT c_custkey, 1 AS n, least('old-' || c_nationkey, 'new-' || c_nationkey) AS least FROM customer) ON c_custkey = o_custkey""",
)
def backfill_repeated(spark, folder):
    """A customer's package is fetched twice, and differs; every order stays one row."""
    host = F.lit("https://host.example.org/")
    o = table(spark, folder, "orders")
    doc = F.to_json(F.struct(text("o_orderkey").alias("id"), F.lit("git").alias("source"), F.concat(host, text("o_custkey")).alias("metadata_uri")))
    catalog = shape.normalize(o.select(F.col("o_orderkey").alias("pos"), F.parse_json(doc).alias("raw")))
    package = lambda p: F.from_json(F.to_json(F.struct(tag(p, "c_nationkey").alias("profile"))), catalog.schema["datapackage"].dataType)
    c = table(spark, folder, "customer")
    fetched = reduce(DataFrame.union, [c.select(F.concat(host, text("c_custkey")).alias("metadata_uri"), package(p).alias("datapackage")) for p in ("old-", "new-")])
    return mutate.backfill(catalog, fetched).select("pos", "backfill_status", F.col("datapackage.profile").alias("profile"))


@query(
    "repeated_fetches",
    "SELECT 'customer-' || o_custkey AS metadata_uri, count(*) AS n, count(DISTINCT o_orderstatus) AS n_different FROM orders GROUP BY 1 HAVING count(*) > 1",
)
def repeated(spark, folder):
    o = table(spark, folder, "orders")
    return mutate.repeated_fetches(o.select(tag("customer-", "o_custkey").alias("metadata_uri"), F.struct("o_orderstatus").alias("datapackage")))


@query("catalog_json_blocks", "SELECT o_orderkey AS id, o_orderpriority || ' {\"[,]' AS name, ['x', 'é\n' || o_custkey] AS tags, TRUE AS ranked FROM orders")
def catalog_json_blocks(spark, folder):
    """Orders as one indented JSON array in one file, with brackets and quotes in texts, read by blocks of 64 KB."""
    path = fresh_path(spark, "array")
    o = table(spark, folder, "orders")
    doc = F.struct(
        text("o_orderkey").alias("id"), F.concat("o_orderpriority", F.lit(' {"[,]')).alias("name"),
        F.array(F.lit("x"), F.concat(F.lit("é\n"), "o_custkey")).alias("tags"),
    )
    write_catalog_array(o.select(F.col("o_orderkey").alias("pos"), F.to_variant_object(doc).alias("raw")), path, single_file=True)
    catalog = read_catalog_json_blocks(spark, path, block=1 << 16)
    # the array is in order of the keys, so positions are, too
    before = F.lag(F.col("id").cast("long")).over(Window.partitionBy(F.floor(F.col("pos") / 1000)).orderBy("pos"))
    rows = catalog.select(F.col("id").cast("long").alias("id"), "name", "tags", "pos")
    return rows.withColumn("ranked", F.coalesce(before < F.col("id"), F.lit(True))).drop("pos")


@query(
    "read_delimited_quoted_breaks",
    """SELECT doc_id AS k, nullif(regexp_replace(replace(replace(coalesce(text, ''), chr(13), ''), chr(0), ''), '^ +| +$', '', 'g'), '') AS note FROM documents""",
)
def delimited_quoted_breaks(spark, folder):
    """Whole texts of documents as quoted cells, line breaks included, a comment behind every record."""
    path = fresh_path(spark, "delimited")
    d = table(spark, folder, "documents")
    note = F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), "\r\x00", ""), "^ +| +$", "")
    cell = F.concat(F.lit('"'), F.replace(note, F.lit('"'), F.lit('""')), F.lit('"'))
    lines = d.select(F.col("doc_id").alias("n"), F.concat(text("doc_id"), F.lit(";"), cell, F.lit('# a "note; of it')).alias("value"))
    first = spark.createDataFrame([(None, "# documents\nk;note")], lines.schema)
    lines.unionByName(first).repartitionByRange("n").sortWithinPartitions("n").select("value").write.text(path)
    found = read_delimited(spark, {"path": path, "seperator": ";", "comment": "#"}, infer=False, block=1 << 18)
    return found.select(F.col("k").cast("long").alias("k"), "note")
