"""Queries on validation reports."""

from __future__ import annotations

from ..operators import lookup, validate
from .registry import query
from .views import LEAVES, leaves, listing

_REPORT = {
    "path": """
  SELECT dataset_id, pos, path, 'path' AS "check", path AS value,
         CASE WHEN path <> '' AND path IN (SELECT path FROM listing) THEN 'success' ELSE 'error' END AS status,
         CASE WHEN path = '' THEN 'path is missing'
              WHEN path IN (SELECT path FROM listing) THEN path || ' was found' ELSE path || ' was not found' END AS message
  FROM leaves""",
    "format": """
  SELECT dataset_id, pos, path, 'format' AS "check", format AS value,
         CASE WHEN format = '' THEN 'error' ELSE 'success' END AS status,
         CASE WHEN format = '' THEN 'format is missing' ELSE format || ' exists' END AS message FROM leaves""",
    "description": """
  SELECT dataset_id, pos, path, 'description' AS "check", description AS value,
         CASE WHEN coalesce(description, '') = '' THEN 'warning' ELSE 'success' END AS status,
         CASE WHEN coalesce(description, '') = '' THEN 'description is missing' ELSE description || ' exists' END AS message
  FROM leaves""",
    "size": """
  SELECT dataset_id, pos, path, 'size' AS "check", CAST(size AS VARCHAR) AS value,
         CASE WHEN coalesce(size, 0) = 0 THEN 'warning' ELSE 'success' END AS status,
         CASE WHEN coalesce(size, 0) = 0 THEN 'size is missing' ELSE size || ' exists' END AS message FROM leaves""",
    "fields": """
  SELECT dataset_id, pos, path, 'fields' AS "check", n || ' fields in total' AS value,
         CASE WHEN n = 0 THEN 'warning' WHEN names > 0 THEN 'error' WHEN texts > 0 THEN 'warning' ELSE 'success' END AS status,
         CASE WHEN n = 0 THEN 'fields is missing'
              WHEN names > 0 THEN n || ' fields: ' || names || ' names missing; ' || texts || ' descriptions missing.'
              WHEN texts > 0 THEN n || ' fields: ' || texts || ' descriptions missing.'
              ELSE n || ' fields: all names and descriptions filled in.' END AS message
  FROM counts""",
}

REPORT = f"WITH {LEAVES}, report AS ({' UNION ALL '.join(_REPORT.values())})"


def _report(spark, folder):
    return validate.validate(leaves(spark, folder), listing(spark, folder))


def _one(check):
    def run(spark, folder):
        files = listing(spark, folder) if check == "path" else None
        return validate.validate(leaves(spark, folder), files, (check,))

    return run


for _check, _sql in _REPORT.items():
    query(f"validate_{_check}", f"WITH {LEAVES} {_sql}")(_one(_check))


@query("validate_report", f"{REPORT} SELECT * FROM report")
def validate_report(spark, folder):
    return _report(spark, folder)


@query(
    "validate_rollup",
    f"""{REPORT} SELECT "check", status, count(*) AS n FROM report GROUP BY "check", status""",
)
def validate_rollup(spark, folder):
    return validate.roll_up(_report(spark, folder))


def _level(level):
    return lambda spark, folder: lookup.filter_report(_report(spark, folder), level)


query("validate_warnings", f"{REPORT} SELECT * FROM report WHERE status IN ('warning', 'error')")(_level("warning"))
query("validate_errors", f"{REPORT} SELECT * FROM report WHERE status = 'error'")(_level("error"))
query("validate_successes", f"{REPORT} SELECT * FROM report WHERE status = 'success'")(_level("all"))


@query(
    "field_gaps",
    f"""WITH {LEAVES} SELECT dataset_id, pos, CAST(n AS BIGINT) AS n_fields, CAST(names AS BIGINT) AS names_missing,
CAST(texts AS BIGINT) AS descriptions_missing FROM counts""",
)
def field_gaps(spark, folder):
    return validate.field_counts(leaves(spark, folder))
