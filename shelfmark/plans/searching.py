"""Search and lookup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.similarity import token_set_ratio
from ..operators import index, lookup, search
from ..session import fresh_path
from .registry import query
from .views import DOCS, PARTS, docs, parts, table

# Similarity in SQL, over "given": (a, b) texts; gives "ratio": (a, b, score).
# Word sets are made once per distinct text. The common subsequence is a recursion
# that carries one row of the table; it is needed only where it can change the score.
def _ratio(given: str, normalize: bool = True, floor: float = 0) -> str:
    words = (
        r"split(lower(regexp_replace({0}, '[^\p{{L}}\p{{N}}_]+', ' ', 'g')), ' ')"
        if normalize
        else r"regexp_split_to_array({0}, '[\s\p{{Z}}\x0b\x1c-\x1f\x85]+')"
    )
    listed = f"list_filter(list_distinct({words.format('t')}), lambda w: w <> '')"
    return rf"""
given AS ({given}),
words AS (
  SELECT t, {listed} AS w FROM (SELECT a AS t FROM given UNION SELECT b FROM given) WHERE t IS NOT NULL),
split AS (
  SELECT g.a, g.b, len(wa.w) = 0 OR len(wb.w) = 0 AS empty,
         list_intersect(wa.w, wb.w) AS common,
         array_to_string(list_sort(list_filter(wa.w, lambda w: NOT list_contains(wb.w, w))), ' ') AS x,
         array_to_string(list_sort(list_filter(wb.w, lambda w: NOT list_contains(wa.w, w))), ' ') AS y
  FROM (SELECT DISTINCT a, b FROM given WHERE a IS NOT NULL AND b IS NOT NULL) g
  JOIN words wa ON wa.t = g.a JOIN words wb ON wb.t = g.b),
sized AS (
  SELECT a, b, x, y, empty, length(array_to_string(common, ' ')) AS s,
         CASE WHEN len(common) > 0 THEN 1 ELSE 0 END AS e, length(x) AS lx, length(y) AS ly
  FROM split),
wanted AS (
  SELECT DISTINCT x, y FROM sized
  WHERE NOT empty AND lx > 0 AND ly > 0
    AND 100.0 - 100.0 * abs(lx - ly) / (2 * s + 2 * e + lx + ly) >= {floor}),
steps(x, y, i, dp) AS (
  SELECT x, y, CAST(0 AS BIGINT), list_transform(range(0, length(y) + 1), lambda j: CAST(0 AS BIGINT)) FROM wanted
  UNION ALL
  SELECT x, y, i + 1,
         list_transform(range(0, length(y) + 1), lambda j: list_max(list_transform(range(0, j + 1), lambda k:
           greatest(dp[k + 1],
                    CASE WHEN k > 0 AND substring(x, i + 1, 1) = substring(y, k, 1) THEN dp[k] + 1 ELSE 0 END))))
  FROM steps WHERE i < length(x)),
common_parts AS (SELECT x, y, dp[length(y) + 1] AS n FROM steps WHERE i = length(x)),
ratio AS (
  SELECT z.a, z.b,
    CASE WHEN empty THEN 0.0
         WHEN s > 0 AND (lx = 0 OR ly = 0) THEN 100.0
         ELSE greatest(
           CASE WHEN n IS NULL THEN 0.0 ELSE 100.0 - 100.0 * (lx + ly - 2 * n) / (2 * s + 2 * e + lx + ly) END,
           CASE WHEN s = 0 THEN 0.0 ELSE 100.0 - 100.0 * (e + lx) / (s + s + e + lx) END,
           CASE WHEN s = 0 THEN 0.0 ELSE 100.0 - 100.0 * (e + ly) / (s + s + e + ly) END) END AS score
  FROM sized z LEFT JOIN common_parts c ON c.x = z.x AND c.y = z.y)
"""


def _scored(catalog_cte: str, fields: str, keywords: list[str], floor: float = 0, normalize: bool = True) -> str:
    """CTEs ending in scored(pos, id, name, score); ``fields`` selects (pos, v)."""
    words = ", ".join(f"('{k}')" for k in keywords)
    return f"""WITH RECURSIVE {catalog_cte},
fields AS ({fields}),
keywords(k) AS (VALUES {words}),
{_ratio("SELECT v AS a, k AS b FROM fields, keywords", normalize, floor)},
best AS (
  SELECT f.pos, max(r.score) AS score FROM fields f JOIN ratio r ON r.a = f.v GROUP BY f.pos),
"""


PART_FIELDS = """
  SELECT pos, name AS v FROM parts UNION ALL SELECT pos, id FROM parts
  UNION ALL SELECT pos, repository FROM parts UNION ALL SELECT pos, description FROM parts
  UNION ALL SELECT pos, p_brand FROM parts UNION ALL SELECT pos, p_type FROM parts"""

PART_SCORED = """scored AS (SELECT c.pos, c.id, c.name, round(coalesce(b.score, 0), 4) AS score
  FROM parts c LEFT JOIN best b ON b.pos = c.pos)
"""

PART_WORDS = ["Hot, ring", "promo 13"]

PART_SEARCH = _scored(PARTS, PART_FIELDS, PART_WORDS) + PART_SCORED


@query("keyword_search", PART_SEARCH + "SELECT pos, id, name, score FROM scored WHERE score >= 50")
def keyword_search(spark, folder):
    return search.search(parts(spark, folder), PART_WORDS).select("pos", "id", "name", "score")


@query(
    "keyword_search_topk",
    PART_SEARCH + "SELECT pos, id, score FROM scored WHERE score >= 50 ORDER BY score DESC, pos LIMIT 10",
)
def keyword_search_topk(spark, folder):
    return search.search(parts(spark, folder), PART_WORDS, limit=10).select("pos", "id", "score")


@query("search_indexed", PART_SEARCH + "SELECT pos, id, name, score FROM scored WHERE score >= 50")
def search_indexed(spark, folder):
    """The index of all parts is written, then searched."""
    path, catalog = fresh_path(spark, "index"), parts(spark, folder)
    index.write_search_index(catalog, path)
    found = index.search_indexed(spark, path, PART_WORDS)
    return catalog.select("pos", "id", "name").join(found, ["pos", "id"]).select("pos", "id", "name", "score")


@query(
    "search_score_all",
    PART_SEARCH + "SELECT pos, id, score FROM scored",
)
def search_score_all(spark, folder):
    return search.search_score(parts(spark, folder), PART_WORDS).select("pos", "id", "score")


@query(
    "search_score_raw_text",
    _scored(PARTS, PART_FIELDS, PART_WORDS, normalize=False) + PART_SCORED + "SELECT pos, id, score FROM scored",
)
def search_score_raw_text(spark, folder):
    scored = search.search_score(parts(spark, folder), PART_WORDS, normalize=False)
    return scored.select("pos", "id", "score")


@query(
    "search_by_keys",
    _scored(PARTS, "SELECT pos, description AS v FROM parts UNION ALL SELECT pos, category FROM parts", ["promo", "brand 2 small"])
    + PART_SCORED + "SELECT pos, id, score FROM scored WHERE score >= 60",
)
def search_by_keys(spark, folder):
    found = search.search(
        parts(spark, folder), ["promo", "brand 2 small"], min_score=60, keys=["description", "category"]
    )
    return found.select("pos", "id", "score")


@query("search_result_count", PART_SEARCH + "SELECT count(*) AS n_results FROM scored WHERE score >= 50")
def search_result_count(spark, folder):
    return search.result_count(search.search_score(parts(spark, folder), PART_WORDS, min_score=50))


DOC_FIELDS = """
  SELECT pos, name AS v FROM docs UNION ALL SELECT pos, id FROM docs
  UNION ALL SELECT pos, description FROM docs
  UNION ALL SELECT pos, lang FROM docs UNION ALL SELECT pos, origin FROM docs"""

DOC_WORDS = ["und der tion", "french src3", "thand"]


@query(
    "document_search",
    _scored(DOCS, DOC_FIELDS, DOC_WORDS, floor=50)
    + "scored AS (SELECT c.pos, c.id, round(b.score, 4) AS score FROM docs c JOIN best b ON b.pos = c.pos) "
    "SELECT pos, id, score FROM scored WHERE score >= 50",
)
def document_search(spark, folder):
    """Whole texts as descriptions. The SQL twin, too, skips pairs that cannot reach 50."""
    return search.search(docs(spark, folder), DOC_WORDS).select("pos", "id", "score")


NEIGHBOURS = """
  SELECT l.p_name AS a, r.p_name || ' ' || r.p_type AS b FROM part l JOIN part r ON r.p_partkey = l.p_partkey + 1"""


def _neighbours(spark, folder):
    left = table(spark, folder, "part").select("p_partkey", F.col("p_name").alias("a"))
    right = table(spark, folder, "part").select(
        (F.col("p_partkey") - 1).alias("p_partkey"), F.concat("p_name", F.lit(" "), "p_type").alias("b")
    )
    return left.join(right, "p_partkey")


@query(
    "token_set_ratio",
    f"""WITH RECURSIVE {_ratio(NEIGHBOURS)}
SELECT l.p_partkey, round(z.score, 4) AS score FROM part l
JOIN part r ON r.p_partkey = l.p_partkey + 1
JOIN ratio z ON z.a = l.p_name AND z.b = r.p_name || ' ' || r.p_type""",
)
def token_set(spark, folder):
    return token_set_ratio(_neighbours(spark, folder), "a", "b").select("p_partkey", "score")


@query(
    "token_set_raw",
    f"""WITH RECURSIVE {_ratio(NEIGHBOURS, normalize=False)}
SELECT l.p_partkey, round(z.score, 4) AS score FROM part l
JOIN part r ON r.p_partkey = l.p_partkey + 1
JOIN ratio z ON z.a = l.p_name AND z.b = r.p_name || ' ' || r.p_type""",
)
def token_set_raw(spark, folder):
    pairs = token_set_ratio(_neighbours(spark, folder), "a", "b", normalize=False)
    return pairs.select("p_partkey", "score")


@query(
    "search_fields",
    f"""WITH {PARTS}
SELECT id, pos, 'name' AS key, name AS value FROM parts
UNION ALL SELECT id, pos, 'id', id FROM parts
UNION ALL SELECT id, pos, 'repository', repository FROM parts
UNION ALL SELECT id, pos, 'description', description FROM parts
UNION ALL SELECT id, pos, 'tags__0', p_brand FROM parts
UNION ALL SELECT id, pos, 'tags__1', p_type FROM parts""",
)
def search_fields(spark, folder):
    return lookup.search_fields(parts(spark, folder))


@query("lookup_ids", f"WITH {PARTS} SELECT pos, id, name FROM parts WHERE id IN ('part-3', 'part-17', 'part-170', 'none')")
def lookup_ids(spark, folder):
    return lookup.by_ids(parts(spark, folder), ["part-3", "part-17", "part-170", "none"]).select("pos", "id", "name")


@query(
    "lookup_id_table",
    f"WITH {PARTS} SELECT pos, id, name FROM parts WHERE id IN (SELECT 'part-' || l_partkey FROM lineitem WHERE l_quantity >= 50)",
)
def lookup_id_table(spark, folder):
    wanted = table(spark, folder, "lineitem").filter(F.col("l_quantity") >= 50)
    ids = wanted.select(F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("id"))
    return lookup.by_ids(parts(spark, folder), ids).select("pos", "id", "name")


@query("lookup_id_contained", f"WITH {PARTS} SELECT pos, id FROM parts WHERE contains('my-part-1234', id)")
def lookup_id_contained(spark, folder):
    return lookup.by_id_contained(parts(spark, folder), "my-part-1234").select("pos", "id")


@query("first_match", f"WITH {PARTS} SELECT pos, id, name, uri FROM parts WHERE id = 'part-42' ORDER BY pos LIMIT 1")
def first_match(spark, folder):
    return lookup.get_dataset(parts(spark, folder), "part-42").select("pos", "id", "name", "uri")
