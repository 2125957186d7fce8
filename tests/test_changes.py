"""Catalog changes, positions and joins, with one key holding a third of the rows."""

import pytest
from conftest import docs, plan_of
from pyspark.sql import functions as F

from shelfmark import (
    add,
    backfill,
    build_descriptors,
    by_ids,
    dense_position,
    duplicate_ids,
    explode_resources,
    normalize,
    remove,
    select_resource,
    slug_collisions,
    sync_plan,
    union_catalogs,
    upsert,
    with_collisions,
)

from shelfmark.operators.joins import flagged, salted_lookup


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def frame(spark, *items):
    return spark.createDataFrame(list(items), "id string, pos long, name string")


@pytest.fixture(scope="module")
def hot(spark):
    """3,000 rows, a third of them under one id."""
    return spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("id-"), F.col("id").cast("string"))).alias("id"),
        F.col("id").alias("pos"),
        F.lit("new").alias("name"),
    )


def test_add(spark):
    catalog = frame(spark, ("a", 0, "old"), ("geo", 1, "old"))
    new = frame(spark, ("a", 10, "x"), ("b", 12, "late"), ("b", 11, "early"), ("geo-data", 13, "x"))
    merged, rejected = add(catalog, new)
    assert rows(merged, "id", "name") == [("a", "old"), ("b", "early"), ("geo", "old"), ("geo-data", "x")]
    assert rows(rejected, "id", "pos") == [("a", 10), ("b", 12)]


def test_add_hot_id(spark, hot):
    merged, rejected = add(frame(spark, ("id-1", -1, "old")), hot)
    assert merged.count() == 1 + 2000
    assert rows(merged.filter("id = 'hot'"), "id", "pos") == [("hot", 0)]
    assert rejected.count() == 1000


def test_remove_and_empty_catalog(spark):
    catalog = frame(spark, ("a", 0, "x"), ("b", 1, "y"))
    assert rows(remove(catalog, ["b", "none"]), "id") == [("a",)]
    empty = remove(catalog, ["a", "b"])
    assert empty.count() == 0
    assert add(empty, catalog)[0].count() == 2


def test_upsert(spark, hot):
    catalog = frame(spark, ("hot", -2, "old"), ("keep", -1, "old"))
    merged = upsert(catalog, hot)
    assert merged.count() == 1 + 1 + 2000
    assert rows(merged.filter("id in ('hot', 'keep')"), "id", "pos", "name") == [("hot", -2, "new"), ("keep", -1, "old")]
    assert rows(merged.filter("id = 'id-1'"), "pos") == [(0,)]
    assert merged.select("pos").distinct().count() == 2002


def test_duplicates_and_union(spark, hot):
    assert rows(duplicate_ids(hot), "id", "n") == [("hot", 1000)]
    both = union_catalogs({"a": frame(spark, ("x", 0, "n")), "b": frame(spark, ("x", 0, "m"))})
    assert rows(both, "catalog", "id", "name") == [("a", "x", "n"), ("b", "x", "m")]


def test_backfill(spark):
    kind = "struct<profile:string>"
    catalog = spark.createDataFrame(
        [(0, "a", "git", "u0", None), (1, "b", "git", "u1", ("own",)), (2, "c", "s3", "u0", None), (3, "d", "git", "gone", None), (4, "e", "git", None, None)],
        f"pos long, id string, source string, metadata_uri string, datapackage {kind}",
    )
    fetched = spark.createDataFrame([("u0", ("got",)), ("u1", ("other",))], f"metadata_uri string, datapackage {kind}")
    got = {r.id: (r.datapackage and r.datapackage.profile, r.backfill_status) for r in backfill(catalog, fetched).collect()}
    assert got == {
        "a": ("got", "filled"),
        "b": ("own", "present"),
        "c": (None, "unsupported"),
        "d": (None, "missing"),
        "e": (None, "missing"),
    }


def test_dense_position(spark, hot):
    got = dense_position(hot.withColumn("key", F.concat(F.lit("k"), F.col("pos"))).drop("pos"), ["key"], by=["id"])
    numbered = got.groupBy("id").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count_distinct("pos").alias("n"))
    assert numbered.filter("lo <> 0 or hi <> n - 1").count() == 0
    want = {k: i for i, k in enumerate(sorted(f"k{n}" for n in range(0, 3000, 3)))}
    assert {r.key: r.pos for r in got.filter("id = 'hot'").collect()} == want


def test_dense_position_of_a_whole_table(spark):
    df = spark.range(1000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    got = {r.key: r.pos for r in dense_position(df, ["key"]).collect()}
    assert got == {k: i for i, k in enumerate(sorted(got))}
    with pytest.raises(ValueError):
        dense_position(df, [])


def test_hot_dataset_is_one_row(spark, hot):
    none = F.lit(None).cast("string")
    files = hot.select(
        F.col("id").alias("dataset_id"),
        "pos",
        *[F.concat(F.lit(n), F.col("pos")).alias(n) for n in ("name", "path")],
        *[none.alias(n) for n in ("format", "mediatype", "encoding", "profile")],
        F.lit(None).cast("struct<fields:array<struct<name:string,type:string,format:string>>,missingValues:array<string>>").alias("schema"),
    )
    placed = dense_position(files.drop("pos"), ["path"], by=["dataset_id"])
    basics = hot.select("id").distinct().withColumns({"name": none, "source": F.lit("git"), "uri": none})
    built = build_descriptors(basics, placed).cache()
    assert built.count() == 2001 and built.select("pos").distinct().count() == 2001
    back = explode_resources(built)
    assert rows(back, "dataset_id", "pos", "path") == rows(placed, "dataset_id", "pos", "path")
    again = explode_resources(normalize(built.select("raw")))
    assert rows(again, "dataset_id", "pos", "path") == rows(placed, "dataset_id", "pos", "path")


def test_select_resource(spark):
    resources = spark.createDataFrame(
        [("a", 0, "p", "n"), ("a", 1, "q", "n"), ("b", 0, "q", "m")], "dataset_id string, pos long, path string, name string"
    )
    assert rows(select_resource(resources, idx=0, path="q"), "dataset_id", "path") == [("a", "p"), ("b", "q")]
    assert rows(select_resource(resources, path="q", name="n"), "dataset_id", "pos") == [("a", 1), ("b", 0)]
    assert rows(select_resource(resources, name="n"), "dataset_id", "pos") == [("a", 0)]
    reported = select_resource(resources, name="n", report_missing=True)
    assert rows(reported, "dataset_id", "found") == [("a", True), ("b", False)]
    with pytest.raises(ValueError):
        select_resource(resources)


def test_select_resource_in_a_catalog(spark):
    def doc(id, *pairs):
        items = ",".join('{"path":"%s","name":"%s"}' % p for p in pairs)
        return '{"id":"%s","datapackage":{"resources":[%s]}}' % (id, items)

    catalog = docs(spark, doc("a", ("p", "n"), ("q", "n")), doc("b", ("q", "m")), doc("c"), '{"id":"d"}')
    assert rows(select_resource(catalog, idx=1, path="q"), "dataset_id", "pos", "path") == [("a", 1, "q")]
    assert rows(select_resource(catalog, path="q"), "dataset_id", "pos") == [("a", 1), ("b", 0)]
    assert rows(select_resource(catalog, name="n"), "dataset_id", "pos") == [("a", 0)]
    reported = select_resource(catalog, name="n", report_missing=True)
    assert rows(reported, "dataset_id", "found") == [("a", True), ("b", False), ("c", False), ("d", False)]
    assert "Exchange" not in plan_of(select_resource(catalog, name="n"))
    table = explode_resources(catalog)
    assert rows(select_resource(catalog, path="q"), *table.columns[:4]) == rows(select_resource(table, path="q"), *table.columns[:4])


def test_slug_collisions_of_a_hot_slug(spark, hot):
    catalog = hot.select(F.when(F.col("id") == "hot", F.concat(F.lit("Hót! "), F.lpad("pos", 0, " "))).otherwise(F.col("id")).alias("id"))
    assert rows(slug_collisions(catalog), "slug", "n") == [("hot", 1000)]
    counted = with_collisions(catalog)
    assert counted.filter("slug = 'hot' and n = 1000").count() == 1000
    assert counted.count() == 3000


def test_hot_keys_of_a_lookup_do_not_meet(spark):
    """With a third of the rows under one key, and one under null, tasks stay even."""
    left = spark.range(24_000).select(
        F.when(F.col("id") % 3 == 0, "hot")
        .when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id")))
        .alias("key"),
        F.col("id").alias("pos"),
    )
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("lost", 3)], "key string, n int")
    settings = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for name in settings:
        spark.conf.set(name, "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = salted_lookup(left, right, "key", ["pos"])
        assert got.count() == 24_000
        counts = {r["n"]: r["count"] for r in got.groupBy("n").count().collect()}
        assert counts == {1: 8000, 2: 1, None: 15_999}
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 3.5 * 24_000 / 8
    finally:
        for name in settings:
            spark.conf.unset(name)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_existence_joins(spark, hot):
    ids = spark.createDataFrame([("hot",), ("hot",), ("id-1",), ("id-2",), (None,), ("none",)], "id string")
    assert rows(by_ids(hot, ids), "id", "pos") == rows(hot.filter("id in ('hot', 'id-1', 'id-2')"), "id", "pos")
    assert rows(remove(hot, ids), "id", "pos") == rows(hot.filter("id not in ('hot', 'id-1', 'id-2')"), "id", "pos")
    asked = hot.unionByName(spark.createDataFrame([(None, -1, "x")], "id string, pos long, name string"))
    found = flagged(asked, ids, "id", "there", ["pos"])
    assert found.columns == ["id", "pos", "name", "there"]
    assert found.count() == 3001 and found.filter("there").count() == 1002
    assert remove(asked, ids).count() == 1999
    assert flagged(hot.limit(0), ids, "id", "there", ["pos"]).count() == 0


def test_existence_joins_split_a_hot_key(spark):
    """Adaptive execution splits the key; building the plans runs no job."""
    left = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("id"), F.col("id").alias("pos"), F.sha2(F.col("id").cast("string"), 512).alias("name")
    )
    ids = spark.range(30_000).select(F.when(F.col("id") == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("id"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plans", "plans")
    try:
        plans = [by_ids(left, ids), remove(left, ids), flagged(left, ids, "id", "there", ["pos"])]
        assert not tracker.getJobIdsForGroup("plans")
        for df in (plans[0], plans[1]):
            df.collect()
            assert "skew=true" in plan_of(df)
        # one existence join, the left side once, its hot key in many tasks
        plan = plan_of(plans[2])
        assert plan.count("ExistenceJoin") == 1 and plan.count("Range (0, 60000") == 1
        sizes = plans[2].where("id = 'hot' AND there").groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in sizes) == 20_000 and max(r["count"] for r in sizes) < 12_000
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k in settings:
            spark.conf.unset(k)


def test_sync_plan(spark):
    kind = "path string, size long, mtime long"
    src = spark.createDataFrame([("a", 1, 5), ("b", 1, 5), ("c", 1, 5), ("d", 2, 5), ("e", 0, 5)], kind)
    dst = spark.createDataFrame([("a", 1, 5), ("b", 1, 9), ("c", 1, 4), ("d", 1, 9), ("x", 1, 1)], kind)
    assert rows(sync_plan(src, dst), "path", "action") == [
        ("a", "same"), ("b", "same"), ("c", "changed"), ("d", "changed"), ("e", "new"),
    ]
