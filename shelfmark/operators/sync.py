"""What must be copied from one file listing to another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sync_plan(src: DataFrame, dst: DataFrame) -> DataFrame:
    """(path, size, action) per source file: new, changed or same.

    Listings have unique path, size and mtime. A file is copied when it is missing
    at the target, its size differs, or the source is newer.
    """
    there = dst.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    action = (
        F.when(F.col("_size").isNull() & F.col("_mtime").isNull(), "new")
        .when((F.col("size") != F.col("_size")) | (F.col("mtime") > F.col("_mtime")), "changed")
        .otherwise("same")
    )
    return src.join(there, "path", "left").select("path", "size", action.alias("action"))


def sync_summary(plan: DataFrame) -> DataFrame:
    """Files and bytes per action."""
    return plan.groupBy("action").agg(
        F.count("*").alias("n_files"), F.sum("size").cast("long").alias("n_bytes")
    )
