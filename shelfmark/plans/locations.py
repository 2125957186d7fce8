"""Queries on URIs, locations, slugs, formats and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import locate, shape
from ..sinks.pages import render_pages
from .registry import query
from .views import ORDER_RESOURCES, PARTS, order_documents, parts, table, tag, text, with_raw


@query(
    "metadata_uri",
    f"""WITH {PARTS} SELECT id,
CASE source WHEN 'git' THEN 'https://raw.githubusercontent.com/' || repository || '/main/dataset.json'
            ELSE 's3://promo/' || pos || '/dataset.json' END AS metadata_uri
FROM parts WHERE source IN ('git', 's3')""",
)
def metadata_uri(spark, folder):
    return locate.with_metadata_uri(parts(spark, folder))[0].select("id", "metadata_uri")


@query(
    "metadata_uri_legacy",
    f"""WITH {PARTS} SELECT id,
CASE source WHEN 'git' THEN 'https://raw.githubusercontent.com/' || lower(p_type) || '/'
              || CASE WHEN p_size > 25 THEN replace(name, ' ', '-') ELSE left(replace(name, ' ', '-'), length(name) - 4) END
              || '/dev/dataset.json'
            ELSE 's3://promo/' || pos || '/dataset.json' END AS metadata_uri
FROM parts WHERE source IN ('git', 's3')""",
)
def metadata_uri_legacy(spark, folder):
    found = locate.with_metadata_uri(parts(spark, folder), branch="dev", legacy=True)[0]
    return found.select("id", "metadata_uri")


@query("metadata_uri_rejects", f"WITH {PARTS} SELECT id, source FROM parts WHERE source = 'disk'")
def metadata_uri_rejects(spark, folder):
    return locate.with_metadata_uri(parts(spark, folder))[1].select("id", "source")


# pages served over https stand for repositories on a supported host
_REPOS = r"""
repos AS (
  SELECT page_id, regexp_replace(url, '^https://([^/]+)/', 'https://github.com/\1/') AS url FROM pages),
parsed AS (
  SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS protocol,
         regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host,
         regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM repos),
repo_parts AS (
  SELECT *, split_part(path, '/', 2) AS owner, regexp_replace(split_part(path, '/', 3), '\.git$', '') AS name,
         CASE WHEN host = 'github.com' THEN 'https://raw.githubusercontent.com' || path END AS metadata_uri,
         host = 'github.com' AS supported FROM parsed)
"""


def _repos(spark, folder):
    url = F.regexp_replace("url", "^https://([^/]+)/", "https://github.com/$1/")
    return locate.parse_repo_urls(table(spark, folder, "pages").select("page_id", url.alias("url")), "url")


@query(
    "repo_urls",
    f"WITH {_REPOS} SELECT page_id, protocol, host, owner, name, path, metadata_uri, supported FROM repo_parts",
)
def repo_urls(spark, folder):
    return _repos(spark, folder).select("page_id", "protocol", "host", "owner", "name", "path", "metadata_uri", "supported")


@query(
    "repo_url_parts",
    r"""SELECT page_id, CASE WHEN page_id % 3 = 1 THEN 'ssh' ELSE regexp_extract(url, '^(https?)', 1) END AS protocol,
       CASE page_id % 3 WHEN 0 THEN 'me' WHEN 1 THEN 'git' END AS "user",
       CASE WHEN page_id % 3 = 0 THEN 8443 END AS port,
       regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS resource FROM pages""",
)
def repo_url_parts(spark, folder):
    """Page addresses with a user and a port, in the short form, and as they are."""
    rest = F.regexp_extract("url", "^https?://([^/]+)(/.*)$", 2)
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    kind = F.col("page_id") % 3
    url = (
        F.when(kind == 0, F.concat(F.regexp_extract("url", "^(https?://)", 1), F.lit("me@"), host, F.lit(":8443"), rest))
        .when(kind == 1, F.concat(F.lit("git@"), host, F.lit(":"), F.substring(rest, F.lit(2), F.length(rest))))
        .otherwise(F.col("url"))
    )
    pages = table(spark, folder, "pages").select("page_id", url.alias("url"))
    return locate.parse_repo_urls(pages, "url").select("page_id", "protocol", "user", "port", "resource")


@query(
    "repo_hosts",
    f"WITH {_REPOS} SELECT host, owner, supported, count(*) AS n FROM repo_parts GROUP BY host, owner, supported",
)
def repo_hosts(spark, folder):
    return locate.repo_hosts(_repos(spark, folder))


@query(
    "resolve_paths",
    f"""WITH {ORDER_RESOURCES}, here AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
SELECT r.dataset_id, r.pos, r.name, r.path,
       CASE WHEN h.l_orderkey IS NOT NULL THEN 'local' WHEN r.source = 'git' THEN 'git' ELSE 'direct' END AS kind,
       CASE WHEN h.l_orderkey IS NOT NULL THEN '/data/' || r.dataset_id || '/' || r.path
            WHEN r.source = 'git' THEN replace(r.metadata_uri, 'dataset.json', '') || r.path ELSE r.path END AS location,
       h.l_orderkey IS NOT NULL OR r.source = 'git' AS supported
FROM order_resources r LEFT JOIN here h ON h.l_orderkey = r.order_key""",
)
def resolve_paths(spark, folder):
    """Orders with a returned line count as downloaded."""
    catalog = shape.normalize(order_documents(spark, folder))
    here = (
        table(spark, folder, "lineitem")
        .filter(F.col("l_returnflag") == "R")
        .select(tag("order-", "l_orderkey").alias("id"))
    )
    return locate.resolve_paths(catalog, here, "/data/")


@query(
    "legacy_urls",
    """SELECT o_orderkey, 'https://raw.githubusercontent.com/owner' || o_custkey || '/' || lower(o_orderstatus)
|| '/master/dataset/' || o_orderkey || '.csv' AS url FROM orders""",
)
def legacy_urls(spark, folder):
    leaves = table(spark, folder, "orders").select(
        "o_orderkey",
        F.concat(tag("owner", "o_custkey"), F.lit("/"), F.lower("o_orderstatus")).alias("repository"),
        F.concat(F.lit("dataset/"), text("o_orderkey"), F.lit(".csv")).alias("path"),
    )
    return locate.legacy_urls(leaves).select("o_orderkey", "url")


# page titles as ids: several languages, accents and punctuation
_TITLES = r"""
titles AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS id FROM pages),
slugs AS (SELECT page_id, id, trim(regexp_replace(lower(replace(strip_accents(id), 'ß', 'ss')), '[^a-z0-9]+', '-', 'g'), '-') AS slug
          FROM titles)
"""


def _titles(spark, folder):
    return table(spark, folder, "pages").select(
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("id")
    )


@query("slug_index", f"WITH {_TITLES} SELECT id, slug FROM slugs")
def slug_index(spark, folder):
    return locate.slug_index(_titles(spark, folder))


def _names(spark, folder):
    """Part names: many datasets share a page."""
    return table(spark, folder, "part").select(F.col("p_name").alias("id"), F.col("p_partkey").alias("pos"))


@query(
    "slug_collisions",
    "SELECT replace(p_name, ' ', '-') AS slug, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1",
)
def slug_collisions(spark, folder):
    return locate.slug_collisions(_names(spark, folder))


@query(
    "slug_with_collisions",
    """SELECT p_name AS id, replace(p_name, ' ', '-') AS slug, count(*) OVER (PARTITION BY p_name) AS n FROM part""",
)
def slug_with_collisions(spark, folder):
    return locate.with_collisions(_names(spark, folder))


@query(
    "file_format",
    r"""SELECT page_id, url AS path, CASE WHEN length(split_part(url, '.', -1)) >= 10 THEN '' ELSE split_part(url, '.', -1) END AS format
FROM pages""",
)
def file_format(spark, folder):
    return locate.with_format(table(spark, folder, "pages").select("page_id", F.col("url").alias("path")))


@query(
    "page_keywords",
    f"""WITH {PARTS} SELECT id, 'keywords:' || chr(10) || '  - "' || p_brand || '"' || chr(10) || '  - "' || p_type || '"' || chr(10) AS keywords FROM parts""",
)
def page_keywords(spark, folder):
    return locate.page_keywords(parts(spark, folder))


@query(
    "render_pages_short",
    f"""WITH {PARTS} SELECT id, replace(id, '_', '-') AS slug,
'---' || chr(10) || 'title: "' || name || '"' || chr(10) || 'description: "' || description || '"' || chr(10)
|| 'keywords:' || chr(10) || '  - "' || p_brand || '"' || chr(10) || '  - "' || p_type || '"' || chr(10)
|| 'category: ' || category || chr(10) || '---' || chr(10) || '  ' AS page FROM parts""",
)
def render_pages_short(spark, folder):
    return render_pages(parts(spark, folder), "short")


@query(
    "render_pages",
    f"""WITH {PARTS} SELECT id, id AS slug, '---' || chr(10) || '{{"description":"' || description || '","id":"' || id || '","name":"' || name
|| '","tags":["' || p_brand || '","' || p_type || '"],"title":"' || name || '"}}' || chr(10) || '---' || chr(10) || '  ' AS page FROM parts""",
)
def render_full_pages(spark, folder):
    return render_pages(with_raw(parts(spark, folder), "id", "name", "description", "tags"))
