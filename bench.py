"""Headline queries on one table folder; prints one JSON line.

Every query is run once to warm up and then BENCH_RUNS times (default 3); its time is
the median of building the plan and running it in full (no-op sink).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shelfmark.plans import QUERIES  # noqa: E402
from shelfmark.session import session  # noqa: E402

HEADLINE = (
    "keyword_search", "keyword_search_topk", "search_score_all", "document_search", "token_set_ratio",
    "lookup_ids", "lookup_id_table", "resources", "fields", "resource_by_name", "summary_kv",
    "flatten_events", "normalize_defaults", "add_unique", "add_rejects", "upsert", "backfill",
    "catalog_from_responses", "validate_report", "validate_rollup", "metadata_uri", "repo_urls",
    "resolve_paths", "slug_with_collisions", "infer_types", "declared_cast_failures",
    "build_descriptors", "build_leaves", "sync_plan", "render_pages", "catalog_lines", "read_resource",
    "list_files", "catalog_dir", "infer_resources", "resource_failures", "materialize", "write_pages",
    "read_delimited_long_comments", "create_register_save", "backfill_saved", "search_indexed",
)


def run(spark, folder: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = session(
        "shelfmark-bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        run(spark, folder, name)
        times[name] = round(statistics.median(run(spark, folder, name) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
