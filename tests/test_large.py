"""What only shows on larger tables, brought about on small ones."""

from __future__ import annotations

import json

import duckdb
from compare import compare
from conftest import TABLES, plan_of
from pyspark.sql import functions as F

from shelfmark.operators.joins import flagged, known, salted_lookup
from shelfmark.operators.locate import resolve_paths
from shelfmark.operators.shape import with_document, with_text
from shelfmark.plans import QUERIES, SQL
from shelfmark.plans.views import spread
from shelfmark.sinks.pages import write_pages
from shelfmark.sources.blocks import file_blocks
from shelfmark.sources.catalogs import read_catalog_json, read_catalog_lines
from shelfmark.sources.files import list_files, read_texts


def test_an_array_is_not_parsed_again_for_each_of_its_items(spark, tmp_path):
    documents = [{"id": str(i), "text": "x" * 50} for i in range(20)]
    (tmp_path / "a.json").write_text(json.dumps(documents))
    catalog, rejects = read_catalog_json(spark, str(tmp_path), with_rejects=True)
    above, generate, _ = plan_of(rejects).partition("Generate")
    assert generate and "value#" not in above
    assert [r.id for r in catalog.orderBy("pos").select("id").collect()] == [str(i) for i in range(20)]
    assert rejects.isEmpty()


def test_types_of_a_table_whose_first_split_has_no_row(spark, tmp_path):
    """One row group in the middle of its file belongs to a later split."""
    con = duckdb.connect()
    for name in ("customer", "supplier"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{TABLES}/{name}.parquet')")
        spark.read.parquet(f"{TABLES}/{name}.parquet").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "1000")
    try:
        error, n, _, _ = compare(QUERIES["infer_resources"](spark, str(tmp_path)), con, SQL["infer_resources"])
    finally:
        spark.conf.set(size, before)
    assert (error, n) == (None, 2)


def test_repeated_keys_are_not_broadcast(spark):
    left = spark.range(100).select(F.col("id").cast("string").alias("key"), F.col("id").alias("pos"))
    right = left.filter("pos % 2 = 0").select("key")
    asked, looked = flagged(left, right, "key", "there", ["pos"]), salted_lookup(left, right.groupBy("key").count(), "key", ["pos"])
    assert "Broadcast" not in plan_of(asked) + plan_of(looked)
    assert asked.filter("there").count() == looked.filter("count = 1").count() == 50


def test_a_key_that_is_listed_twice_is_repeated_once(spark):
    left = spark.range(10).select(F.col("id").cast("string").alias("key"), F.col("id").alias("pos"))
    found = flagged(left, left.crossJoin(spark.range(50).select("id")), "key", "there", ["pos"])
    assert found.filter("there").count() == found.count() == 10
    assert "HashAggregate" in plan_of(found).partition("Generate")[2]


def test_one_row_group_in_many_splits_is_spread(spark, tmp_path):
    spark.range(2000).coalesce(1).write.parquet(f"{tmp_path}/one")
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "200")
    try:
        found = spread(spark.read.parquet(f"{tmp_path}/one"))
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set(size, before)
    assert sum(sizes) == 2000 and max(sizes) < 500


def test_parts_with_nested_values_are_spread(spark):
    for name in ("search_nested_values", "validate_catalog"):
        assert "REPARTITION_BY_NUM" in plan_of(QUERIES[name](spark, TABLES))


def test_small_blocks_share_tasks(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": str(i)} for i in range(2000)]))
    blocks = file_blocks(spark, str(tmp_path), 16)
    assert blocks.count() > 1000
    assert blocks.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism


def test_texts_of_many_files(spark, tmp_path):
    rows = spark.range(300).select(F.lit("page").alias("slug"), F.col("id").cast("string").alias("id"), F.concat(F.lit("é\n"), F.col("id")).alias("page"))
    write_pages(rows.coalesce(1), str(tmp_path / "pages"))
    found = read_texts(list_files(spark, str(tmp_path / "pages"), glob="*.md"))
    assert sorted(r.value for r in found.collect()) == sorted(f"é\n{i}" for i in range(300))
    assert found.select(F.spark_partition_id()).distinct().count() > 8


def test_documents_of_columns_are_written_without_a_variant(spark):
    package = "struct<profile string, resources array<struct<path string, name string, schema struct<missingValues array<string>, fields array<struct<name string, type string>>>>>>"
    new = spark.createDataFrame(
        [(0, "a", 'é "x"\n', ["t", None], ("p", [("b", None, (["", None], [("n", "t")])), None])), (1, "b", None, None, None), (2, "", None, [], ("p", None))],
        f"pos long, id string, name string, tags array<string>, datapackage {package}",
    )
    want = [r.doc for r in with_document(new).select("pos", F.to_json("raw").alias("doc")).orderBy("pos").collect()]
    assert [r.doc for r in with_text(new).orderBy("pos").collect()] == want
    assert want[2] == '{"datapackage":{"profile":"p"},"id":"","tags":[]}'
    # beside rows with a document, of which one has a changed column and keys of its own
    old = with_document(new.filter("pos < 2")).withColumn("raw", F.when(F.col("pos") == 0, F.parse_json(F.lit('{"z": [1.50], "id": "a", "name": "old"}'))).otherwise(F.col("raw")))
    both = old.unionByName(new.filter("pos = 2"), allowMissingColumns=True)
    assert [r.doc for r in with_text(both).orderBy("pos").collect()] == [
        want[0][:-1] + ',"z":[1.5]}', want[1], want[2]
    ]


def test_lines_are_numbered_without_a_sort(spark, tmp_path):
    lines = [line for i in range(300) for line in (json.dumps({"id": f"{i:04}"}), *[" "] * (i % 3))]
    for k, part in enumerate((lines[:250], [""], lines[250:])):
        (tmp_path / f"part-{k}.txt").write_text("\n".join(part) + "\n")
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "500")
    try:
        catalog = read_catalog_lines(spark, str(tmp_path))
        assert [(r.pos, r.id) for r in catalog.orderBy("pos").collect()] == [(i, f"{i:04}") for i in range(300)]
        assert "Sort " not in plan_of(catalog).partition("Broadcast")[0] and "SortMergeJoin" not in plan_of(catalog)
    finally:
        spark.conf.set(size, before)


def test_keys_of_a_catalog_are_not_repeated(spark):
    catalog = spark.range(20).selectExpr("cast(id AS string) AS id", "'git' AS source", "'u/dataset.json' AS metadata_uri", "named_struct('resources', array(named_struct('name', 'n', 'path', 'p'))) AS datapackage")
    found = resolve_paths(catalog, catalog.filter("id < 5").union(catalog.filter("id < 5")).select("id"), "/w")
    assert "sequence" not in plan_of(found) and "Broadcast" not in plan_of(found)
    assert sorted(r.kind for r in found.collect()) == ["git"] * 15 + ["local"] * 5


def test_known_keys_and_a_hot_one(spark):
    left = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id"))).alias("key"), F.sha2(F.col("id").cast("string"), 512).alias("name")
    )
    keys = spark.createDataFrame([("hot",), ("hot",), ("k1",), (None,)], "key string")
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        found = known(left, keys, "key", "there")
        got = {(r["key"], r["there"]): r["count"] for r in found.withColumn("key", F.left("key", F.lit(3))).where("key IS NULL OR key IN ('hot', 'k1')").groupBy("key", "there").count().collect()}
        assert got == {("hot", True): 20_000, ("k1", True): 1, (None, False): 20_000}
        found.collect()
        assert "skew=true" in plan_of(found)
    finally:
        for k in settings:
            spark.conf.unset(k)


def test_listed_paths_are_not_repeated(spark):
    leaves = QUERIES["validate_report"](spark, TABLES)
    assert "sequence" not in plan_of(leaves) and "ExistenceJoin" not in plan_of(leaves)
