"""Catalogs from folder trees, aggregated files and fetched responses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.position import dense_position, scan_position
from ..operators.shape import normalize
from ..session import stage
from .blocks import BLOCK, json_array_records


def _sorted_out(
    docs: DataFrame, order: list[str], with_rejects: bool, place: Callable[..., DataFrame] = dense_position
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """The catalog of documents (file, the columns ``order``, body), and what is none.

    ``place`` gives the positions in this order. A document is a JSON object. With ``with_rejects`` all others are returned as (file,
    index, body, reason); without, the first one met is an error.
    """
    parsed = docs.withColumn("raw", F.try_parse_json("body"))
    if "whole" in docs.columns:  # an object where an array is asked for is no catalog
        parsed = parsed.withColumn("raw", F.when(F.col("whole"), F.col("raw")))
    # of valid JSON, an object is what opens with a brace
    good = F.col("raw").isNotNull() & F.col("body").rlike(r"^\x{FEFF}?\s*\{")
    if not with_rejects:
        fault = F.raise_error(F.concat(F.lit("no descriptor in "), F.coalesce("file", F.lit("")))).cast("variant")
        whole = parsed.withColumn("raw", F.when(good, F.col("raw")).otherwise(fault))
        return normalize(place(whole.drop("body"), order).select("pos", "raw"))
    catalog = normalize(place(parsed.where(good).drop("body"), order).select("pos", "raw"))
    reason = F.when(F.col("raw").isNull(), "not valid JSON").otherwise("not a JSON object")
    return catalog, parsed.where(~good).select("file", "index", "body", reason.alias("reason"))


def read_catalog_dir(
    spark: SparkSession, path: str, descriptor: str = "dataset.json", with_rejects: bool = False
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """One dataset per sub-folder with a file ``descriptor`` (a name or a glob).

    ``pos`` is the rank of the file's path. A file that holds no JSON object is an
    error, or with ``with_rejects`` a row of the second table (file, index, body, reason).
    """
    docs = spark.read.text(f"{path.rstrip('/')}/*/{descriptor}", wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.lit(0).cast("long").alias("index"), F.col("value").alias("body")
    )
    return _sorted_out(docs, ["file"], with_rejects)


def read_catalog_json(
    spark: SparkSession, path: str, with_rejects: bool = False
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Datasets of JSON arrays: one file, or several in path order.

    ``pos`` is the index over all arrays. One array is read by one task;
    ``write_catalog_array`` writes one per task, and ``read_catalog_json_blocks`` is for
    arrays too large for that. A file that is no array, or an
    item that is no object, is an error, or with ``with_rejects`` a row of the second
    table; blank files hold nothing.
    """
    files = spark.read.text(path, wholetext=True).where(F.trim("value") != "")
    # an array as a whole, or nothing: a broken one is one rejected document
    whole = F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>").isNotNull()
    # the mark is in the items: beside the explode, a file would be parsed again for each of them
    marked = lambda items, mark: F.transform(items, lambda b: F.struct(b.alias("body"), F.lit(mark).alias("whole")))
    items = F.when(whole, marked(F.from_json("value", "array<string>"), True)).otherwise(marked(F.array("value"), False))
    docs = files.select(
        F.col("_metadata.file_path").alias("file"), F.posexplode(items).alias("_n", "_item")
    ).select("file", F.col("_n").cast("long").alias("index"), "_item.body", "_item.whole")
    return _sorted_out(docs, ["file", "index"], with_rejects)


def read_catalog_json_blocks(
    spark: SparkSession, path: str, with_rejects: bool = False, block: int = BLOCK
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Datasets of JSON arrays of any size: the blocks of a file are read by many tasks.

    The rows are those of ``read_catalog_json``. Items are cut before they are parsed, so a
    broken item is an error, or a reject, by itself; ``index`` of a reject is its place in
    bytes. Text behind an array and an array that does not end are rejects, too.
    """
    items = json_array_records(spark, path, block)
    # cut once, and kept: positions need them in order, rejects need them again
    return _sorted_out(stage(items, "items"), ["file", "index"], with_rejects)


def read_catalog_lines(
    spark: SparkSession, path: str, with_rejects: bool = False
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Datasets of JSON Lines files; ``pos`` is the line number over all files in path order.

    Inside one block of a file lines are read in order, so they are counted by (file, block),
    whatever way blocks were given to tasks, and not sorted. Blank lines are
    skipped; a line that holds no object is an error, or a row of the second table.
    """
    lines = (
        spark.read.text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("index"),
            F.col("value").alias("body"),
        )
        .filter(F.trim("body") != "")
    )
    return _sorted_out(lines, ["file", "block"], with_rejects, scan_position)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A catalog kept as a Parquet table by ``write_catalog``."""
    return spark.read.parquet(path)


def catalog_from_responses(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(catalog, rejects) from fetched bodies: (pos, uri, status, body).

    A body is one descriptor or an array of descriptors. Responses other than 200,
    bodies that do not parse, and those that hold anything but objects are rejected, with
    a ``reason``. The position is request number * 2^32 + index in the body: unique and
    in order without a sort; request numbers from 2^31 on are an error.
    """
    parsed = responses.withColumn(
        "_doc", F.when(F.col("status") == 200, F.try_parse_json("body"))
    )
    items = F.coalesce(
        F.try_variant_get("_doc", "$", "array<variant>"), F.array("_doc")
    )
    objects = F.forall(items, lambda v: F.try_variant_get(v, "$", "map<string,variant>").isNotNull())
    parsed = parsed.withColumn("_good", F.col("_doc").isNotNull() & F.coalesce(objects, F.lit(False)))
    request = F.col("_request").cast("long")
    small = F.when(request < (1 << 31), request).otherwise(F.raise_error(F.lit("request number over 2^31")).cast("long"))
    datasets = (
        parsed.filter("_good")
        .select(F.col("pos").alias("_request"), "uri", F.posexplode(items).alias("_item", "raw"))
        .select(
            (F.shiftleft(small, 32) + F.col("_item")).alias("pos"),
            F.col("uri").alias("fetched_from"),
            "raw",
        )
    )
    rejects = parsed.filter(~F.col("_good")).select(
        *responses.columns,
        F.when(F.coalesce(F.col("status") != 200, F.lit(True)), "status is not 200")
        .when(F.col("_doc").isNull(), "body is not valid JSON")
        .otherwise("body holds no descriptor")
        .alias("reason"),
    )
    return normalize(datasets), rejects
