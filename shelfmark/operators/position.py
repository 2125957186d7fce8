"""Dense positions in a given order, ranked on all executors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage


def dense_position(
    df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), name: str = "pos"
) -> DataFrame:
    """Add the 0-based rank of each row within ``by``, in ``order``.

    A window would bring a whole group (without ``by``: the whole table) into one
    task. Here the rows are range-partitioned and sorted by (by, order) and written
    once; the position is the place inside the partition plus the count of the
    group's rows in earlier partitions. Only those counts, at most one per partition
    and group, pass through a window.
    """
    if not order:
        raise ValueError("a position needs an order")
    placed = stage(
        df.repartitionByRange(*by, *order)
        .sortWithinPartitions(*by, *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id()),
        "position",
    )
    earlier = (
        Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        placed.groupBy(*by, "_part")
        .agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    if not by:
        offsets = F.broadcast(offsets)  # one row per partition of the range sort
    # null keys are groups, too
    keys = {key: f"_by_{i}" for i, key in enumerate([*by, "_part"])}
    offsets = offsets.withColumnsRenamed(keys)
    same = reduce(and_, [F.col(f"`{key}`").eqNullSafe(F.col(new)) for key, new in keys.items()])
    return (
        placed.join(offsets, same)
        .withColumn(name, (F.col("_before") + F.col("_row") - F.col("_first")).cast("long"))
        .drop("_part", "_row", "_first", "_before", *keys.values())
    )


def scan_position(df: DataFrame, blocks: Sequence[str], name: str = "pos") -> DataFrame:
    """Add the 0-based rank of each row of a scan: by ``blocks``, inside a block as it is read.

    ``blocks`` tell the blocks of files apart; a task reads the rows of one in order. So no row is
    sorted or moved: they are written once with a number, and the counts of the blocks, one row for
    each, pass through a window.
    """
    placed = stage(df.withColumn("_row", F.monotonically_increasing_id()), "position")
    earlier = Window.orderBy(*blocks).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*blocks)
        .agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    return (
        placed.join(F.broadcast(offsets), list(blocks))
        .withColumn(name, (F.col("_before") + F.col("_row") - F.col("_first")).cast("long"))
        .drop("_row", "_first", "_before")
    )
