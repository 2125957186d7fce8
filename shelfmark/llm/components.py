"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def _stars(edges: DataFrame, label: str) -> DataFrame:
    """Rows (u, v) with the smallest neighbour of u, or u itself, as ``m``.

    The minima are written before the join: both sides of it are then plain
    exchanges, of which adaptive execution splits those of a hub.
    """
    least = stage(edges.groupBy("u").agg(F.min("v").alias("m")), label)
    return edges.join(least, "u").withColumn("m", F.least("u", "m"))


def _only_stars(edges: DataFrame) -> bool:
    """Whether every u has one edge and no v is a u: each v is then the root of its component."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(edges.select("v", F.lit(0)).toDF("node", "up"))
    node = ends.groupBy("node").agg(F.sum("up").alias("n"), F.min("up").alias("up"))
    return not node.where("n > 1 or n = 1 and up = 0").agg(F.count("*")).first()[0]


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v); root is the smallest node reachable.

    Every step hangs neighbours on the smallest one known, so that edges become stars
    in a logarithmic number of rounds; as soon as there are only stars no round follows.
    The edges of each round are written to the shared folder; nothing but the number of
    nodes that are in no star reaches the driver. No edges
    give no rows; loops, repeated edges and edges with a null end are ignored.
    """
    edges = stage(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    for _ in range(rounds):
        if _only_stars(edges):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stage(
            _stars(both, "large").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(),
            "edges",
        )
        small = _stars(large, "small")
        edges = stage(
            small.select("u", F.col("m").alias("v"))
            .unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .distinct(),
            "edges",
        )
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
