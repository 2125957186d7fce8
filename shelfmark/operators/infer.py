"""Descriptors and column types from raw files."""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.charsets import recode
from ..functions.text import extension, metadata_uri
from ..schema import RESOURCE, spark_type
from ..sources.files import file_system, list_files, relative_path
from .position import dense_position
from .shape import with_document

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The text form of each type.
PATTERNS = {
    "integer": r"^[+-]?\d{1,18}$",
    "number": r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$",
    "boolean": r"^(?i:true|false)$",
    "date": r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$",
    "datetime": (
        r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])[ T]([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,9})?)?"
        r"(Z|[+-]\d{2}:?\d{2})?$"
    ),
}

# Types from narrow to wide, and the forms that count for each.
ORDER = ("integer", "number", "boolean", "date", "datetime")
FORMS = {
    "integer": ("integer",),
    "number": ("integer", "number"),
    "boolean": ("boolean",),
    "date": ("date",),
    "datetime": ("datetime",),
}


def _kind(cell: Column) -> Column:
    """The narrowest type a cell's text has the form of.

    The first character decides which patterns are tried at all.
    """

    def first_of(kinds: Sequence[str]) -> Column:
        out = F.lit("string")
        for kind in reversed(kinds):
            out = F.when(cell.rlike(PATTERNS[kind]), kind).otherwise(out)
        return out

    start = F.left(cell, F.lit(1))
    numeric = start.isin(*"0123456789+-.")
    return (
        F.when(numeric, first_of([k for k in ORDER if k != "boolean"]))
        .when(start.isin(*"tTfF"), first_of(["boolean"]))
        .otherwise("string")
    )


def _votes() -> list[Column]:
    """Counts over the column ``kind``, null for missing cells."""
    kind = F.col("kind")
    return [
        F.count("*").alias("n"),
        F.count_if(kind.isNull()).alias("n_missing"),
        *[F.count_if(kind.isin(*FORMS[k])).alias(f"n_{k}") for k in ORDER],
    ]


def _elected(confidence: float) -> Column:
    """The narrowest type with a sufficient share of the non-missing cells."""
    need = F.lit(confidence) * (F.col("n") - F.col("n_missing"))
    chosen = F.lit("string")
    for kind in reversed(ORDER):
        votes = F.col(f"n_{kind}")
        chosen = F.when((votes >= need) & (votes > 0), kind).otherwise(chosen)
    return chosen


def _cell_kind(cell: Column, missing: Sequence[str]) -> Column:
    return F.when(~(cell.isNull() | cell.isin(list(missing))), _kind(cell))


def infer_types(
    df: DataFrame, confidence: float = 0.75, missing: Sequence[str] = ("",)
) -> DataFrame:
    """(column, n, n_missing, one vote count per type, type) of text columns.

    The type is the narrowest one that at least ``confidence`` of a column's
    non-missing cells have the form of; else string. All rows are read once; the
    cells are counted per column before the shuffle.
    """
    cells = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]).unpivot(
        [], [F.col(f"`{c}`") for c in df.columns], "column", "cell"
    )
    kinds = cells.select("column", _cell_kind(F.col("cell"), missing).alias("kind"))
    return kinds.groupBy("column").agg(*_votes()).withColumn("type", _elected(confidence))


def _clean(name: str, missing: Sequence[str]) -> Column:
    cell = F.col(f"`{name}`").cast("string")
    return F.when(~cell.isin(list(missing)), cell)


def cast_cell(cell: Column, declared: str) -> Column:
    """A text cell in its declared type; null where the text has not the type's form."""
    kind = spark_type(declared)
    if declared in ("object", "array"):
        return F.try_parse_json(cell)
    if declared == "year":
        return F.when(cell.rlike(r"^\d{4}$"), cell.try_cast(kind))
    if declared in PATTERNS:
        fits = cell.rlike(PATTERNS[declared])
        if declared == "number":
            fits = fits | cell.rlike(PATTERNS["integer"])
        return F.when(fits, cell.try_cast(kind))
    return cell


def cast_declared(
    df: DataFrame, fields: Sequence[Mapping], missing: Sequence[str] | None = ("",)
) -> DataFrame:
    """Text columns in their declared types; missing values and misfits are null."""
    return df.select(
        *[cast_cell(_clean(f["name"], missing or ()), f["type"]).alias(f["name"]) for f in fields]
    )


def cast_failures(
    df: DataFrame, fields: Sequence[Mapping], missing: Sequence[str] | None = ("",)
) -> DataFrame:
    """(column, type, n, n_missing, n_failed) of declared columns, in one pass."""
    kinds = {f["name"]: f["type"] for f in fields}
    checks = F.array(
        *[
            F.struct(
                F.lit(name).alias("column"),
                F.lit(kind).alias("type"),
                _clean(name, missing or ()).isNull().alias("gone"),
                cast_cell(_clean(name, missing or ()), kind).isNull().alias("bad"),
            )
            for name, kind in kinds.items()
        ]
    )
    return (
        df.select(F.inline(checks))
        .groupBy("column", "type")
        .agg(
            F.count("*").alias("n"),
            F.count_if("gone").alias("n_missing"),
            F.count_if(~F.col("gone") & F.col("bad")).alias("n_failed"),
        )
    )


def _first_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The header of each file. Only the head of a file is fetched, however long it is."""
    for batch in batches:
        names = []
        for uri, encoding in zip(batch["uri"].to_pylist(), batch["encoding"].to_pylist()):
            system, path = file_system(uri)
            with system.open_input_stream(path) as raw, io.TextIOWrapper(
                io.BufferedReader(raw), encoding=encoding, errors="replace", newline=""
            ) as text:
                names.append(next(csv.reader(text), []))
        yield pa.RecordBatch.from_arrays(
            [batch["path"], pa.array(names, pa.list_(pa.string()))], names=["path", "names"]
        )


def csv_headers(files: DataFrame) -> DataFrame:
    """(path, names): the first record of every listed CSV file (path, uri, encoding)."""
    encoding = F.col("encoding") if "encoding" in files.columns else F.lit("utf-8")
    heads = files.select("path", "uri", F.coalesce(encoding, F.lit("utf-8")).alias("encoding"))
    return heads.mapInArrow(_first_records, "path string, names array<string>")


def csv_fields(files: DataFrame) -> DataFrame:
    """(path, fields): header names as fields with empty descriptions."""
    return csv_headers(files).select(
        "path",
        F.transform(
            "names", lambda n: F.struct(n.alias("name"), F.lit("").alias("description"))
        ).alias("fields"),
    )


def build_leaves(files: DataFrame, fields: DataFrame, user: DataFrame | None = None) -> DataFrame:
    """Leaf rows of listed files (path, size).

    ``fields`` gives (path, fields) of the CSV files; other files get two blank
    fields. ``user`` gives (path, name, description, updated_at) where known.
    """
    blank_field = F.struct(F.lit("").alias("name"), F.lit("").alias("description"))
    leaves = files.select("path", "size", extension(F.col("path")).alias("format")).join(
        fields.select("path", "fields"), "path", "left"
    )
    if user is not None:
        leaves = leaves.join(user.select("path", "name", "description", "updated_at"), "path", "left")
    texts = [
        (F.coalesce(c, F.lit("")) if user is not None else F.lit("")).alias(c)
        for c in ("name", "description", "updated_at")
    ]
    return leaves.select(
        texts[0],
        texts[1],
        "path",
        "format",
        "size",
        texts[2],
        F.when(F.col("format") == "csv", F.col("fields"))
        .otherwise(F.array(blank_field, blank_field))
        .alias("fields"),
    )


def _encoding(valid: Column, c1: Column) -> Column:
    """utf-8 if all bytes are valid; else windows-1252 if a byte 0x80-0x9F occurs."""
    return F.when(valid, "utf-8").when(c1, "windows-1252").otherwise("iso-8859-1")


def _decoded(name: Column, encoding: Column) -> Column:
    """A text read as ISO-8859-1 in its encoding."""
    return (
        F.when(encoding == "utf-8", F.encode(name, "ISO-8859-1").cast("string"))
        .when(encoding == "windows-1252", recode(name, "windows-1252"))
        .otherwise(name)
    )


def column_votes(
    spark: SparkSession,
    root: str,
    glob: str = "*.csv",
    missing: Sequence[str] = ("",),
    multi_line: bool = False,
) -> DataFrame:
    """(path, encoding, field_pos, field, n, n_missing, votes) of every column of every CSV file.

    One pass over all files, also if their headers and charsets differ: they are read
    by column number, under the widest header, and as ISO-8859-1, which keeps every
    byte. Type patterns are ASCII; the charset is told from the bytes of the cells
    (separators are ASCII, so a line is valid if its cells are). Cells are counted by
    (file, column) before the shuffle, however large a file is. The header is one line
    of its file: its cell is taken out of the counts again.
    """
    files = list_files(spark, root, glob=glob).select("path", "uri")
    # names that Spark's readers leave out are not part of a dataset
    files = files.filter(~F.col("path").rlike(r"(^|/)[._]"))
    headers = csv_headers(files.withColumn("encoding", F.lit("iso-8859-1"))).select(
        "path", F.posexplode_outer("names").alias("field_pos", "field")
    )
    # the schema of a read is fixed on the driver: one number
    width = (headers.agg(F.max("field_pos")).first()[0] or 0) + 1
    table = spark.read.csv(
        root,
        schema=", ".join(f"c{i} string" for i in range(width)),
        recursiveFileLookup=True,
        pathGlobFilter=glob,
        encoding="ISO-8859-1",
        quote='"',
        escape='"',
        multiLine=multi_line,
    )
    # one row for each cell that a line has, and one (-1) for the line: absent cells cost nothing
    number = F.transform(F.array(*[F.col(f"c{i}") for i in range(width)]), lambda c, i: F.struct(i.alias("i"), c.alias("c")))
    line = F.array(F.struct(F.lit(-1).alias("i"), F.lit(None).cast("string").alias("c")))
    found = F.concat(line, F.filter(number, lambda x: x["c"].isNotNull()))
    cells = table.select(relative_path(root).alias("path"), F.explode(found).alias("_x")).select(
        "path", F.col("_x.i").alias("field_pos"), F.col("_x.c").alias("cell")
    )
    cell = F.col("cell")
    high = F.octet_length(cell) > F.length(cell)
    votes = (
        cells.select(
            "path",
            "field_pos",
            _cell_kind(cell, missing).alias("kind"),
            F.when(high, F.is_valid_utf8(F.encode(cell, "ISO-8859-1").cast("string")))
            .otherwise(True)
            .alias("valid"),
            F.when(high, cell.rlike(r"[\x80-\x9f]")).otherwise(False).alias("c1"),
        )
        .groupBy("path", "field_pos")
        .agg(*_votes(), F.bool_and("valid").alias("valid"), F.bool_or("c1").alias("c1"))
    )
    encodings = votes.groupBy("path").agg(
        _encoding(F.bool_and("valid"), F.bool_or("c1")).alias("encoding"),
        F.max(F.when(F.col("field_pos") == -1, F.col("n"))).alias("_lines"),
    )
    votes = votes.filter("field_pos >= 0").drop("valid", "c1")
    head = _cell_kind(F.col("field"), missing)

    def without_header(name: str, is_head: Column) -> Column:
        count = F.col(name) - F.coalesce(is_head, F.lit(False)).cast("int")
        return F.greatest(F.coalesce(count, F.lit(0)), F.lit(0)).alias(name)

    encoding = F.coalesce("encoding", F.lit("utf-8"))
    return (
        headers.join(votes, ["path", "field_pos"], "left")
        .join(encodings, "path", "left")
        .select(
            "path",
            encoding.alias("encoding"),
            F.col("field_pos").cast("long").alias("field_pos"),
            _decoded(F.col("field"), encoding).alias("field"),
            F.greatest(F.coalesce("_lines", F.lit(0)) - 1, F.lit(0)).alias("n"),
            # a missing cell is blank, or not there at all
            F.greatest(
                F.coalesce("_lines", F.lit(0)) - 1
                - (F.coalesce("n", F.lit(0)) - F.coalesce("n_missing", F.lit(0)))
                + F.coalesce(head.isNotNull(), F.lit(False)).cast("int"),
                F.lit(0),
            ).alias("n_missing"),
            *[without_header(f"n_{k}", head.isin(*FORMS[k])) for k in ORDER],
        )
    )


def infer_resources(
    spark: SparkSession,
    root: str,
    dataset_depth: int = 1,
    glob: str = "*.csv",
    confidence: float = 0.75,
    missing: Sequence[str] = ("",),
    multi_line: bool = False,
) -> DataFrame:
    """Resource rows (dataset_id, pos, name, path, ..., schema) of all CSV files below ``root``.

    The first ``dataset_depth`` segments of a path are the dataset's folder, the rest
    is the resource's path. Encoding and column types are inferred from all lines.
    ``multi_line`` is for files with quoted line breaks.
    """
    votes = column_votes(spark, root, glob, missing, multi_line)
    field = F.struct(
        "field_pos",
        F.col("field").alias("name"),
        _elected(confidence).alias("type"),
        F.lit("default").alias("format"),
    )
    # the fields of one file: as many as its header has
    per_file = votes.groupBy("path", "encoding").agg(
        F.array_sort(F.collect_list(F.when(F.col("field_pos").isNotNull(), field))).alias("_fields")
    )
    steps = F.split("path", "/")
    rows = per_file.select(
        F.array_join(F.slice(steps, 1, dataset_depth), "/").alias("dataset_id"),
        F.regexp_replace(F.element_at(steps, -1), r"\.[^.]*$", "").alias("name"),
        F.array_join(F.slice(steps, dataset_depth + 1, F.size(steps)), "/").alias("path"),
        F.lit("csv").alias("format"),
        F.lit("text/csv").alias("mediatype"),
        "encoding",
        F.lit("tabular-data-resource").alias("profile"),
        F.struct(
            F.transform(
                "_fields",
                lambda f: F.struct(f["name"].alias("name"), f["type"].alias("type"), f["format"].alias("format")),
            ).alias("fields"),
            F.array(*[F.lit(m) for m in missing]).alias("missingValues"),
        ).alias("schema"),
    )
    return dense_position(rows, ["path"], by=["dataset_id"]).select(
        "dataset_id", "pos", *RESOURCE.names
    )


def resource_failures(
    spark: SparkSession,
    root: str,
    declared: DataFrame,
    dataset_depth: int = 1,
    glob: str = "*.csv",
    missing: Sequence[str] = ("",),
    multi_line: bool = False,
) -> DataFrame:
    """Cells that do not have the form of their declared type, over all resources at once.

    ``declared`` has (dataset_id, path, field, type). Gives these with n, n_missing and
    n_failed; types without a form of their own (string, any, ...) never fail.
    """
    steps = F.split("path", "/")
    votes = column_votes(spark, root, glob, missing, multi_line).withColumns(
        {
            "dataset_id": F.array_join(F.slice(steps, 1, dataset_depth), "/"),
            "path": F.array_join(F.slice(steps, dataset_depth + 1, F.size(steps)), "/"),
        }
    )
    fits = F.col("n") - F.col("n_missing")
    for kind in ORDER:
        fits = F.when(F.col("type") == kind, F.col(f"n_{kind}")).otherwise(fits)
    return declared.join(votes, ["dataset_id", "path", "field"]).select(
        "dataset_id",
        "path",
        "field",
        "type",
        "n",
        "n_missing",
        (F.col("n") - F.col("n_missing") - fits).alias("n_failed"),
    )


def build_descriptors(
    basics: DataFrame, resources: DataFrame, descriptor: str = "dataset.json"
) -> DataFrame:
    """Whole descriptors, one row each: basics, derived metadata_uri, the data package, pos and raw.

    ``basics`` has unique (id, name, description, source, uri), and may have pos; else
    the positions follow the ids. ``resources`` has (dataset_id, pos, RESOURCE columns).
    A descriptor is one document, so the resources of a dataset meet in its row; where
    they are too many for that, keep them as a table and give it to ``resolve_paths``.
    """
    if "pos" not in basics.columns:
        basics = dense_position(basics, ["id"])
    packages = (
        resources.groupBy(F.col("dataset_id").alias("id"))
        .agg(
            F.sort_array(F.collect_list(F.struct("pos", F.struct(*RESOURCE.names).alias("r")))).alias("_rs")
        )
        .select(
            "id",
            F.struct(
                F.lit("tabular-data-package").alias("profile"),
                F.transform("_rs", lambda s: s.r).alias("resources"),
            ).alias("datapackage"),
        )
    )
    described = basics.withColumn(
        "metadata_uri", metadata_uri(F.col("source"), F.coalesce("uri", F.lit("")), descriptor=descriptor)
    )
    return with_document(described.join(packages, "id", "left"))
