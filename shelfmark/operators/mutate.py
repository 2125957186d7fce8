"""Changes of a catalog. Each returns a new DataFrame; nothing is written in place.

New rows are written once with a number of their own, so that rows equal in every
column can be told apart; one row for each id is chosen by partial aggregation, and
ids are tested by semi and anti joins, of which adaptive execution splits hot keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .position import dense_position


def _one_each(new: DataFrame, pick) -> tuple[DataFrame, DataFrame]:
    """(the new rows with a number ``_number``, for each id the order of the row that ``pick`` chooses)."""
    numbered = stage(new.withColumn("_number", F.monotonically_increasing_id()), "new")
    order = F.struct(F.col("pos"), F.col("_number"))
    return numbered, numbered.groupBy("id").agg(pick(order).alias("_o"))


def _appended(catalog: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (with ``_number``), in order of pos, with the positions after the last of the catalog."""
    last = catalog.agg(F.max("pos")).first()[0]
    placed = dense_position(rows.select("_number", F.col("pos").alias("_old")), ["_old", "_number"], name="_at")
    first = 0 if last is None else last + 1
    return rows.join(placed.select("_number", "_at"), "_number").withColumn("pos", F.col("_at") + F.lit(first).cast("long")).drop("_at")


def add(catalog: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(catalog with the accepted rows, rejected rows).

    A new row is rejected if its id exists already, or earlier in ``new``; of rows with
    one id and position one is accepted. Accepted rows stand after the last of the
    catalog, in their order; rejected ones are as they came.
    """
    numbered, first = _one_each(new, F.min)
    accepted = stage(first.join(catalog.select("id"), "id", "left_anti").select(F.col("_o._number").alias("_number")), "accepted")
    taken = _appended(catalog, numbered.join(accepted, "_number", "left_semi")).drop("_number")
    rejected = numbered.join(accepted, "_number", "left_anti").select(new.columns)
    return catalog.unionByName(taken, allowMissingColumns=True), rejected


def remove(catalog: DataFrame, ids: Sequence[str] | DataFrame) -> DataFrame:
    """The catalog without these ids; absent ids change nothing, files stay."""
    if isinstance(ids, DataFrame):
        return catalog.join(ids.select("id"), "id", "left_anti").select(catalog.columns)
    return catalog.filter(~F.coalesce(F.col("id").isin(list(ids)), F.lit(False)))


def upsert(catalog: DataFrame, new: DataFrame) -> DataFrame:
    """New versions replace rows of the same id; of several new versions the last wins.

    A new version takes the first position of what it replaces; new ids stand after
    the last row of the catalog.
    """
    numbered, last = _one_each(new, F.max)
    chosen = stage(last.select("id", F.col("_o._number").alias("_number")), "chosen")
    rows = numbered.join(chosen.select("_number"), "_number", "left_semi")
    old = stage(catalog.join(chosen.select("id"), "id", "left_semi").groupBy("id").agg(F.min("pos").alias("_pos")), "old")
    there = rows.join(old, "id").withColumn("pos", F.col("_pos")).select(new.columns)
    fresh = _appended(catalog, rows.join(old.select("id"), "id", "left_anti")).select(new.columns)
    kept = remove(catalog, chosen)
    return kept.unionByName(there, allowMissingColumns=True).unionByName(fresh, allowMissingColumns=True)


def backfill(catalog: DataFrame, fetched: DataFrame) -> DataFrame:
    """Fill missing data packages of git datasets from fetched descriptors.

    ``fetched`` has (metadata_uri, datapackage). ``backfill_status`` tells
    present, filled, missing (nothing fetched) or unsupported (source is not git).
    Only rows that need a package are looked up. Filled packages are part of the
    document when the catalog is saved. A dataset stays one row: of several packages
    fetched for one URI the smallest is taken; ``repeated_fetches`` tells which those are.
    """
    needs = F.col("datapackage").isNull() & (F.col("source") == "git")
    left = catalog.withColumn("_uri", F.when(needs, F.col("metadata_uri")))
    # written, so that the join has no aggregate on its right side and a hot URI can be split
    right = stage(
        fetched.where("metadata_uri IS NOT NULL").groupBy(F.col("metadata_uri").alias("_uri")).agg(F.min("datapackage").alias("_body")),
        "fetched",
    )
    joined = left.join(right, "_uri", "left").select(*left.columns, "_body")
    status = (
        F.when(F.col("datapackage").isNotNull(), "present")
        .when(F.col("_body").isNotNull(), "filled")
        .when(F.col("source") == "git", "missing")
        .otherwise("unsupported")
    )
    return joined.withColumns(
        {"backfill_status": status, "datapackage": F.coalesce("datapackage", "_body")}
    ).drop("_uri", "_body")


def repeated_fetches(fetched: DataFrame) -> DataFrame:
    """(metadata_uri, n, n_different) of URIs fetched several times: rows, and packages that differ."""
    different = F.count_distinct(F.xxhash64("datapackage"))
    counted = fetched.groupBy("metadata_uri").agg(F.count("*").alias("n"), different.alias("n_different"))
    return counted.filter(F.col("n") > 1)


def union_catalogs(catalogs: Mapping[str, DataFrame]) -> DataFrame:
    """Named catalogs side by side, told apart by the column ``catalog``."""
    parts = [df.withColumn("catalog", F.lit(name)) for name, df in catalogs.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def duplicate_ids(catalog: DataFrame) -> DataFrame:
    """Ids that occur more than once, with their count."""
    return catalog.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
