"""Queries on nested descriptors: typed columns, resources, fields, entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookup, shape
from .registry import query
from .views import ORDER_RESOURCES, PARTS, order_documents, parts, spread, table, with_raw


def _orders(spark, folder):
    return shape.normalize(order_documents(spark, folder))


@query(
    "normalize_defaults",
    """
SELECT event_id AS pos, CASE WHEN event_type = 'view' THEN '' ELSE 'event-' || event_id END AS id,
       event_type AS name, CASE WHEN event_type = 'error' THEN NULL ELSE 'user ' || user_id END AS description,
       '' AS metadata_uri, CAST(NULL AS VARCHAR) AS repository,
       CASE event_type WHEN 'click' THEN event_type WHEN 'view' THEN NULL ELSE event_type || '|' || user_id END AS tags,
       CASE WHEN event_type = 'signup' THEN 'u' || user_id END AS people
FROM events""",
)
def normalize_defaults(spark, folder):
    """Descriptors with missing keys, and with tags as a text, a list, or none."""
    e, user = F.col("event_type"), F.col("user_id").cast("string")
    common = [
        F.when(e != "view", F.concat(F.lit("event-"), F.col("event_id").cast("string"))).alias("id"),
        e.alias("name"),
        F.when(e != "error", F.concat(F.lit("user "), user)).alias("description"),
        F.when(
            e == "signup", F.array(F.struct(F.concat(F.lit("u"), user).alias("name")))
        ).alias("contributors"),
    ]
    doc = (
        F.when(e == "click", F.to_json(F.struct(*common, e.alias("tags"))))
        .when(e == "view", F.to_json(F.struct(*common)))
        .otherwise(F.to_json(F.struct(*common, F.array(e, user).alias("tags"))))
    )
    raw = spread(table(spark, folder, "events")).select(
        F.col("event_id").alias("pos"), F.parse_json(doc).alias("raw")
    )
    return shape.normalize(raw).select(
        "pos",
        "id",
        "name",
        "description",
        "metadata_uri",
        "repository",
        F.array_join("tags", "|").alias("tags"),
        F.array_join(F.transform("contributors", lambda c: c["name"]), "|").alias("people"),
    )


@query(
    "resources",
    f"WITH {ORDER_RESOURCES} SELECT dataset_id, pos, name, path, format FROM order_resources",
)
def resources(spark, folder):
    return shape.explode_resources(_orders(spark, folder)).select("dataset_id", "pos", "name", "path", "format")


@query(
    "resources_outer",
    f"""WITH {ORDER_RESOURCES} SELECT o.id AS dataset_id, r.pos, r.path
FROM order_sets o LEFT JOIN order_resources r ON r.dataset_id = o.id""",
)
def resources_outer(spark, folder):
    return shape.explode_resources(_orders(spark, folder), outer=True).select("dataset_id", "pos", "path")


@query("fields", f"WITH {ORDER_RESOURCES} SELECT * FROM order_fields")
def fields(spark, folder):
    return shape.explode_fields(_orders(spark, folder))


@query(
    "resource_tree",
    f"""WITH {ORDER_RESOURCES} SELECT o.id, coalesce(string_agg(r.path, chr(10) ORDER BY r.pos), '') AS tree
FROM order_sets o LEFT JOIN order_resources r ON r.dataset_id = o.id GROUP BY o.id""",
)
def resource_tree(spark, folder):
    tree = shape.resource_tree(_orders(spark, folder))
    return tree.select("id", F.array_join("paths", "\n").alias("tree"))


def _selected(exploded=False, **kwargs):
    def run(spark, folder):
        source = _orders(spark, folder)
        if exploded:
            source = shape.explode_resources(source)
        found = lookup.select_resource(source, **kwargs)
        return found.select("dataset_id", "pos", "name", "path", "found")

    return run


_SELECT = f"WITH {ORDER_RESOURCES} SELECT dataset_id, pos, name, path, true AS found FROM order_resources WHERE "

query("resource_by_idx", _SELECT + "pos = 1")(_selected(idx=1, path="ignored"))
query("resource_by_path", _SELECT + "path = 'dataset/notes-5.csv'")(
    _selected(path="dataset/notes-5.csv", name="ignored")
)
query("resource_by_name", _SELECT + "name = 'notes'")(_selected(name="notes"))
query("resource_table_by_name", _SELECT + "name = 'notes'")(_selected(exploded=True, name="notes"))
query(
    "resource_by_name_reported",
    f"""WITH {ORDER_RESOURCES}, sets AS (SELECT id AS dataset_id FROM order_sets)
SELECT s.dataset_id, r.pos, r.name, r.path, r.pos IS NOT NULL AS found
FROM sets s LEFT JOIN order_resources r ON r.dataset_id = s.dataset_id AND r.name = 'trace'""",
)(_selected(name="trace", report_missing=True))


@query(
    "summary_kv",
    f"""WITH {PARTS}
SELECT id, 'ID' AS key, id AS value FROM parts UNION ALL SELECT id, 'Name', name FROM parts
UNION ALL SELECT id, 'Source', source FROM parts UNION ALL SELECT id, 'Description', description FROM parts
UNION ALL SELECT id, 'URI', uri FROM parts UNION ALL SELECT id, 'Metadata', metadata_uri FROM parts""",
)
def summary_kv(spark, folder):
    return shape.summary(parts(spark, folder))


@query(
    "summary_site",
    f"""WITH {PARTS}
SELECT id, 'Name' AS key, name AS value FROM parts UNION ALL SELECT id, 'Dataset ID', id FROM parts
UNION ALL SELECT id, 'Source Type', source FROM parts UNION ALL SELECT id, 'URI', uri FROM parts
UNION ALL SELECT id, 'Metadata URI', metadata_uri FROM parts UNION ALL SELECT id, 'Category', category FROM parts
UNION ALL SELECT id, 'Tags', p_brand || ', ' || p_type FROM parts""",
)
def summary_site(spark, folder):
    return shape.summary(parts(spark, folder), site=True)


@query(
    "describe_line",
    f"""WITH {PARTS} SELECT id, 'Dataset ID: ' || id || chr(10) || 'name: ' || name || chr(10)
|| 'description: ' || description || chr(10) || 'contributors: ' || p_brand || ', ' || p_type AS line FROM parts""",
)
def describe_line(spark, folder):
    people = F.transform("tags", lambda t: F.struct(t.alias("name"), F.lit(None).cast("string").alias("github")))
    return shape.describe(parts(spark, folder).withColumn("contributors", people))


@query(
    "full_metadata",
    f"""WITH {PARTS} SELECT id, '{{"description":"' || description || '","id":"' || id || '","name":"' || name
|| '","pos":' || pos || ',"tags":["' || p_brand || '","' || p_type || '"]}}' AS metadata FROM parts""",
)
def full_metadata(spark, folder):
    return shape.full_metadata(with_raw(parts(spark, folder), "pos", "tags", "name", "id", "description"))


_FLAT = """
SELECT event_id AS id, 'props__k' AS key, json_extract_string(props, '$.k') AS value FROM events
UNION ALL SELECT event_id, 'list__0', event_type FROM events
UNION ALL SELECT event_id, 'list__1', CAST(user_id AS VARCHAR) FROM events
UNION ALL SELECT event_id, 'deep__a__b__0__c', CAST(event_id AS VARCHAR) FROM events
UNION ALL SELECT event_id, 'deep__a__b__1', NULL FROM events
UNION ALL SELECT event_id, 'flag', 'true' FROM events"""


def _flat(max_depth):
    def run(spark, folder):
        doc = F.concat(
            F.lit('{"props":'),
            "props",
            F.lit(',"list":["'),
            "event_type",
            F.lit('",'),
            F.col("user_id").cast("string"),
            F.lit('],"deep":{"a":{"b":[{"c":'),
            F.col("event_id").cast("string"),
            F.lit('},null]}},"flag":true,"none":{},"empty":[]}'),
        )
        events = spread(table(spark, folder, "events")).select(F.col("event_id").alias("id"), doc.alias("doc"))
        return shape.flatten(events, "doc", max_depth=max_depth)

    return run


query("flatten_events", _FLAT)(_flat(8))
query("flatten_beyond_depth", _FLAT)(_flat(2))
