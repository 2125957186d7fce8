"""Queries on catalog changes, sync plans and responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mutate, sync
from ..sources.catalogs import catalog_from_responses
from .registry import query
from .views import table, tag, text, whole

# customers are the catalog; orders are new datasets whose ids repeat and partly exist
ITEMS = """
have AS (SELECT c_custkey AS pos, 'item-' || c_custkey AS id, c_name AS name FROM customer),
fresh AS (
  SELECT o_orderkey AS pos, 'item-' || CAST(floor(o_totalprice / 100) AS BIGINT) AS id,
         o_orderpriority AS name FROM orders),
firsts AS (SELECT id, min(pos) AS pos FROM fresh GROUP BY id),
taken AS (
  SELECT f.* FROM fresh f JOIN firsts USING (id, pos) WHERE f.id NOT IN (SELECT id FROM have)),
placed AS (
  SELECT (SELECT max(pos) FROM have) + row_number() OVER (ORDER BY pos) AS pos, id, name FROM taken)
"""


def _have(spark, folder):
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("pos"), tag("item-", "c_custkey").alias("id"), F.col("c_name").alias("name")
    )


def _fresh(spark, folder):
    hundreds = F.floor(F.col("o_totalprice") / 100).cast("long").cast("string")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("pos"),
        F.concat(F.lit("item-"), hundreds).alias("id"),
        F.col("o_orderpriority").alias("name"),
    )


@query("add_unique", f"WITH {ITEMS} SELECT * FROM have UNION ALL SELECT * FROM placed")
def add_unique(spark, folder):
    return mutate.add(_have(spark, folder), _fresh(spark, folder))[0]


# ten orders share a position, so that ties of id and position occur
_TIED = """
tied AS (SELECT o_orderkey // 10 AS pos, 'item-' || CAST(floor(o_totalprice / 10000) AS BIGINT) AS id FROM orders),
have AS (SELECT c_custkey AS pos, 'item-' || c_custkey AS id FROM customer WHERE c_custkey % 7 = 0),
firsts AS (SELECT id, min(pos) AS pos FROM tied WHERE id NOT IN (SELECT id FROM have) GROUP BY id)
"""


@query(
    "add_ties",
    f"""WITH {_TIED} SELECT 'kept' AS kind, id, count(*) AS n, min(pos) AS pos FROM have GROUP BY id
UNION ALL SELECT 'added', id, 1, NULL FROM firsts
UNION ALL SELECT 'rejected', id, count(*) - CASE WHEN id IN (SELECT id FROM firsts) THEN 1 ELSE 0 END, NULL FROM tied
GROUP BY id HAVING count(*) - CASE WHEN id IN (SELECT id FROM firsts) THEN 1 ELSE 0 END > 0""",
)
def add_ties(spark, folder):
    """One row for each id, also where rows agree in id and position; all others are rejected."""
    tied = table(spark, folder, "orders").select(
        F.expr("o_orderkey div 10").alias("pos"), F.concat(F.lit("item-"), F.floor(F.col("o_totalprice") / 10000).cast("long").cast("string")).alias("id")
    )
    have = _have(spark, folder).filter("pos % 7 = 0").select("pos", "id")
    merged, rejected = mutate.add(have, tied)
    last = have.agg(F.max("pos")).first()[0]
    old = F.col("pos") <= last
    kinds = merged.groupBy(F.when(old, "kept").otherwise("added").alias("kind"), "id").agg(
        F.count("*").alias("n"), F.min(F.when(old, F.col("pos"))).alias("pos")
    )
    return kinds.unionByName(
        rejected.groupBy(F.lit("rejected").alias("kind"), "id").agg(F.count("*").alias("n"), F.lit(None).cast("long").alias("pos"))
    )


@query(
    "add_rejects",
    f"WITH {ITEMS} SELECT f.* FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.id = f.id AND t.pos = f.pos)",
)
def add_rejects(spark, folder):
    return mutate.add(_have(spark, folder), _fresh(spark, folder))[1]


@query(
    "remove_ids",
    f"WITH {ITEMS} SELECT * FROM have WHERE id NOT IN (SELECT 'item-' || s_suppkey FROM supplier)",
)
def remove_ids(spark, folder):
    gone = table(spark, folder, "supplier").select(tag("item-", "s_suppkey").alias("id"))
    return mutate.remove(_have(spark, folder), gone)


@query("remove_listed", f"WITH {ITEMS} SELECT * FROM have WHERE id NOT IN ('item-1', 'item-5', 'none')")
def remove_listed(spark, folder):
    return mutate.remove(_have(spark, folder), ["item-1", "item-5", "none"])


@query(
    "upsert",
    f"""WITH {ITEMS}, lasts AS (SELECT id, max(pos) AS pos FROM fresh GROUP BY id),
newest AS (SELECT f.* FROM fresh f JOIN lasts USING (id, pos))
SELECT * FROM have WHERE id NOT IN (SELECT id FROM lasts)
UNION ALL SELECT h.pos, n.id, n.name FROM newest n JOIN have h USING (id)
UNION ALL SELECT (SELECT max(pos) FROM have) + row_number() OVER (ORDER BY pos), id, name FROM newest
WHERE id NOT IN (SELECT id FROM have)""",
)
def upsert(spark, folder):
    return mutate.upsert(_have(spark, folder), _fresh(spark, folder))


@query(
    "union_catalogs",
    f"""WITH {ITEMS} SELECT 'customers' AS catalog, pos, id, name FROM have
UNION ALL SELECT 'orders', pos, id, name FROM fresh
UNION ALL SELECT 'suppliers', s_suppkey, 'item-' || s_suppkey, s_name FROM supplier""",
)
def union_catalogs(spark, folder):
    suppliers = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("pos"), tag("item-", "s_suppkey").alias("id"), F.col("s_name").alias("name")
    )
    return mutate.union_catalogs(
        {"customers": _have(spark, folder), "orders": _fresh(spark, folder), "suppliers": suppliers}
    )


@query("duplicate_ids", f"WITH {ITEMS} SELECT id, count(*) AS n FROM fresh GROUP BY id HAVING count(*) > 1")
def duplicate_ids(spark, folder):
    return mutate.duplicate_ids(_fresh(spark, folder))


@query(
    "backfill",
    """
SELECT d.doc_id AS pos, CASE d.lang WHEN 'de' THEN 'own' WHEN 'fr' THEN NULL ELSE 'quality-' || l.quality END AS profile,
       CASE WHEN d.lang = 'de' THEN 'present' WHEN d.lang = 'fr' THEN 'unsupported'
            WHEN l.doc_id IS NULL THEN 'missing' ELSE 'filled' END AS backfill_status
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def backfill(spark, folder):
    """German texts have a package, French ones are on s3, the rest is fetched where labelled."""
    uri = F.concat(F.lit("https://host.example.org/"), text("doc_id"), F.lit("/main/dataset.json"))
    empty = F.array().cast("array<struct<name:string>>").alias("resources")
    catalog = table(spark, folder, "documents").select(
        F.col("doc_id").alias("pos"),
        F.concat_ws("-", "source", text("doc_id")).alias("id"),
        F.when(F.col("lang") == "fr", "s3").otherwise("git").alias("source"),
        uri.alias("metadata_uri"),
        F.when(F.col("lang") == "de", F.struct(F.lit("own").alias("profile"), empty)).alias("datapackage"),
    )
    fetched = table(spark, folder, "labels").select(
        uri.alias("metadata_uri"),
        F.struct(tag("quality-", "quality").alias("profile"), empty).alias("datapackage"),
    )
    return mutate.backfill(catalog, fetched).select(
        "pos", F.col("datapackage.profile").alias("profile"), "backfill_status"
    )


# errors are refused, views are not JSON, clicks hold two descriptors
_ANSWERS = """
answers AS (
  SELECT event_id, event_type, CASE event_type WHEN 'error' THEN 500 ELSE 200 END AS status,
         'https://host.example.org/' || event_id AS uri,
         'user ' || user_id AS name, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
"""


def _answers(spark, folder):
    e = F.col("event_type")
    first = F.to_json(
        F.struct(tag("event-", "event_id").alias("id"), tag("user ", "user_id").alias("name"))
    )
    second = F.concat(F.lit('{"id":"second","name":'), "props", F.lit("}"))
    body = (
        F.when(e == "click", F.concat(F.lit("["), first, F.lit(","), second, F.lit("]")))
        .when(e == "view", F.concat(F.lit("{"), "props"))
        .otherwise(first)
    )
    return table(spark, folder, "events").select(
        F.col("event_id").alias("pos"),
        tag("https://host.example.org/", "event_id").alias("uri"),
        F.when(e == "error", 500).otherwise(200).alias("status"),
        body.alias("body"),
    )


@query(
    "catalog_from_responses",
    f"""WITH {_ANSWERS}
SELECT event_id * 4294967296 AS pos, uri AS fetched_from, 'event-' || event_id AS id, name FROM answers
WHERE event_type NOT IN ('error', 'view')
UNION ALL SELECT event_id * 4294967296 + 1, uri, 'second', '{{"k":' || k || '}}' FROM answers WHERE event_type = 'click'""",
)
def from_responses(spark, folder):
    found = catalog_from_responses(_answers(spark, folder))[0]
    return found.select("pos", "fetched_from", "id", "name")


@query(
    "response_rejects",
    f"""WITH {_ANSWERS}
SELECT event_id AS pos, uri, status,
       CASE WHEN status <> 200 THEN 'status is not 200' ELSE 'body is not valid JSON' END AS reason
FROM answers WHERE event_type IN ('error', 'view')""",
)
def response_rejects(spark, folder):
    return catalog_from_responses(_answers(spark, folder))[1].select("pos", "uri", "status", "reason")


# the target lacks pending orders; urgent ones differ in size, high ones are a day old
_PLAN = """
src AS (SELECT 'dataset/' || o_orderkey || '.csv' AS path, CAST(floor(o_totalprice) AS BIGINT) AS size,
               o_orderstatus AS s, o_orderpriority AS p FROM orders),
plan AS (SELECT path, size, CASE WHEN s = 'P' THEN 'new' WHEN p IN ('1-URGENT', '2-HIGH') THEN 'changed' ELSE 'same' END AS action
         FROM src)
"""


def _plan(spark, folder):
    orders, p = table(spark, folder, "orders"), F.col("o_orderpriority")
    path = F.concat(F.lit("dataset/"), text("o_orderkey"), F.lit(".csv")).alias("path")
    src = orders.select(path, whole("o_totalprice").alias("size"), F.col("o_orderdate").alias("mtime"))
    dst = orders.filter(F.col("o_orderstatus") != "P").select(
        path,
        (whole("o_totalprice") + F.when(p == "1-URGENT", 1).otherwise(0)).alias("size"),
        F.when(p == "2-HIGH", F.col("o_orderdate") - F.expr("INTERVAL 1 DAY"))
        .otherwise(F.col("o_orderdate"))
        .alias("mtime"),
    )
    return sync.sync_plan(src, dst)


@query("sync_plan", f"WITH {_PLAN} SELECT path, size, action FROM plan")
def sync_plan(spark, folder):
    return _plan(spark, folder)


@query(
    "sync_summary",
    f"WITH {_PLAN} SELECT action, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS n_bytes FROM plan GROUP BY action",
)
def sync_summary(spark, folder):
    return sync.sync_summary(_plan(spark, folder))
