"""Validation of leaves (declared data files) and of descriptor folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import blank
from ..schema import LEAF
from .joins import known

# Status names and message forms of a report row.
SUCCESS, WARNING, ERROR = "success", "warning", "error"
MISSING, NOT_FOUND, FOUND, EXISTS = " is missing", " was not found", " was found", " exists"

CHECKS = ("path", "format", "description", "size", "fields")


def _row(check: str, value: Column, status: Column, message: Column) -> Column:
    return F.struct(
        F.lit(check).alias("check"),
        value.cast("string").alias("value"),
        status.alias("status"),
        message.alias("message"),
    )


def _check_path() -> Column:
    path, gone = F.col("path"), blank(F.col("path"))
    return _row(
        "path",
        path,
        F.when(~gone & F.col("_found"), SUCCESS).otherwise(ERROR),
        F.when(gone, F.lit("path" + MISSING))
        .when(F.col("_found"), F.concat(path, F.lit(FOUND)))
        .otherwise(F.concat(path, F.lit(NOT_FOUND))),
    )


def _check_filled(check: str, gone: Column, bad: str) -> Column:
    value = F.col(check).cast("string")
    return _row(
        check,
        value,
        F.when(gone, bad).otherwise(SUCCESS),
        F.when(gone, F.lit(check + MISSING)).otherwise(F.concat(value, F.lit(EXISTS))),
    )


def explode_leaves(catalog: DataFrame) -> DataFrame:
    """The leaves (LEAF columns) that descriptors list under ``data``, one row each, in order.

    Sizes may be numbers or texts of numbers; datasets without leaves have no rows.
    """
    kind = T.ArrayType(T.StructType([f for f in LEAF if f.name not in ("dataset_id", "pos")])).simpleString()
    return (
        catalog.select(
            F.col("id").alias("dataset_id"),
            F.posexplode_outer(F.try_variant_get("raw", "$.data", kind)).alias("pos", "_leaf"),
        )
        .filter(F.col("pos").isNotNull())
        .select("dataset_id", F.col("pos").cast("long").alias("pos"), "_leaf.*")
    )


def validate_catalog(
    catalog: DataFrame, files: DataFrame | None = None, checks: tuple[str, ...] = CHECKS
) -> DataFrame:
    """The report on all leaves of a loaded catalog.

    ``files`` lists the files below the catalog: the path of a leaf is looked up below
    the folder of its dataset.
    """
    leaves = explode_leaves(catalog)
    if files is not None:
        below = F.when(~blank(F.col("path")), F.concat("dataset_id", F.lit("/"), "path"))
        report = validate(leaves.withColumn("path", below), files, checks)
        own = F.expr("substring(path, length(dataset_id) + 2)")
        # messages and values name the path as it is declared
        cut = lambda c: F.replace(c, F.concat("dataset_id", F.lit("/")), F.lit(""))
        is_path = F.col("check") == "path"
        return report.withColumns(
            {"value": F.when(is_path, own).otherwise(F.col("value")), "message": F.when(is_path, cut(F.col("message"))).otherwise(F.col("message")), "path": own}
        )
    return validate(leaves, files, checks)


def field_counts(leaves: DataFrame) -> DataFrame:
    """(dataset_id, pos, n_fields, names_missing, descriptions_missing) per leaf."""
    n, names, texts = _field_counts()
    return leaves.select(
        "dataset_id",
        "pos",
        n.alias("n_fields"),
        names.alias("names_missing"),
        texts.alias("descriptions_missing"),
    )


def _field_counts() -> tuple[Column, Column, Column]:
    fields = F.coalesce("fields", F.array().cast("array<struct<name:string,description:string>>"))
    return (
        F.size(fields).cast("long"),
        F.size(F.filter(fields, lambda f: blank(f["name"]))).cast("long"),
        F.size(F.filter(fields, lambda f: blank(f["description"]))).cast("long"),
    )


def _check_fields() -> Column:
    n, names, texts = F.col("_n"), F.col("_names"), F.col("_texts")
    total = F.concat(n.cast("string"), F.lit(" fields: "))
    return _row(
        "fields",
        F.concat(n.cast("string"), F.lit(" fields in total")),
        F.when(n == 0, WARNING).when(names > 0, ERROR).when(texts > 0, WARNING).otherwise(SUCCESS),
        F.when(n == 0, F.lit("fields" + MISSING))
        .when(
            names > 0,
            F.concat(
                total,
                names.cast("string"),
                F.lit(" names missing; "),
                texts.cast("string"),
                F.lit(" descriptions missing."),
            ),
        )
        .when(texts > 0, F.concat(total, texts.cast("string"), F.lit(" descriptions missing.")))
        .otherwise(F.concat(total, F.lit("all names and descriptions filled in."))),
    )


def _with_found(leaves: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``_found``: is the leaf's path in the listing (column ``path``)?"""
    path = F.col("path")
    asked = leaves.withColumn("_path", F.when(~blank(path), path))
    there = files.select(path.alias("_path"))
    return known(asked, there, "_path", "_found").drop("_path")


def validate(
    leaves: DataFrame, files: DataFrame | None = None, checks: tuple[str, ...] = CHECKS
) -> DataFrame:
    """Report rows (dataset_id, pos, path, check, value, status, message).

    One pass over the leaves for all checks; the listing is joined only if the path
    is checked.
    """
    if "path" in checks:
        if files is None:
            raise ValueError("the path check needs a file listing")
        leaves = _with_found(leaves, files)
    if "fields" in checks:
        leaves = leaves.withColumns(dict(zip(("_n", "_names", "_texts"), _field_counts())))
    rows = {
        "path": _check_path,
        "format": lambda: _check_filled("format", blank(F.col("format")), ERROR),
        "description": lambda: _check_filled("description", blank(F.col("description")), WARNING),
        "size": lambda: _check_filled("size", F.coalesce(F.col("size"), F.lit(0)) == 0, WARNING),
        "fields": _check_fields,
    }
    return leaves.select(
        "dataset_id", "pos", "path", F.explode(F.array(*[rows[c]() for c in checks])).alias("_row")
    ).select("dataset_id", "pos", "path", "_row.*")


def roll_up(report: DataFrame) -> DataFrame:
    """Number of report rows per check and status."""
    return report.groupBy("check", "status").agg(F.count("*").alias("n"))


def validate_descriptors(folders: DataFrame, descriptors: DataFrame) -> DataFrame:
    """(folder, status, message): has every folder a descriptor that parses?

    ``folders`` has unique ``folder``; ``descriptors`` has ``folder`` and the file's
    text ``value``.
    """
    parsed = descriptors.select(
        "folder",
        F.lit(True).alias("_there"),
        F.try_parse_json("value").isNotNull().alias("_valid"),
    )
    there, valid = F.col("_there").isNotNull(), F.col("_valid")
    return folders.join(parsed, "folder", "left").select(
        "folder",
        F.when(there & valid, SUCCESS).otherwise(ERROR).alias("status"),
        F.when(~there, F.lit("descriptor" + MISSING))
        .when(valid, F.lit("descriptor" + EXISTS))
        .otherwise("descriptor is not valid JSON")
        .alias("message"),
    )
