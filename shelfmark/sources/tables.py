"""Data files of a resource as DataFrames."""

from __future__ import annotations

import csv
import io
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.charsets import reader_charset, recode, recode_strings
from ..operators.infer import cast_cell, cast_declared, infer_types
from ..schema import to_struct
from .blocks import BLOCK, delimited_records

CORRUPT = "_corrupt_record"


def _as_dict(row: Row | Mapping) -> dict:
    return row.asDict(recursive=True) if isinstance(row, Row) else dict(row)


def read_resource(
    spark: SparkSession,
    resource: Row | Mapping,
    base: str | None = None,
    keep_corrupt: bool = False,
    multi_line: bool = False,
) -> DataFrame:
    """A delimited or JSON resource under its declared schema.

    Declared fields are found by their names in the header, in whatever order they
    stand there; of a name that the header repeats, the first column is taken, and a
    declared field that the file lacks is an error. The columns are the declared ones, in
    declared order. Cells that do not fit their type become null; with
    ``keep_corrupt`` the line of such a row is kept in a column (with several missing
    values, and of JSON: its cells, written again). ``multi_line`` is for quoted line breaks.
    """
    r = _as_dict(resource)
    location = r.get("location") or r["path"]
    if base and not r.get("location"):
        location = f"{base.rstrip('/')}/{location}"
    names = None
    if (r.get("format") or "csv").lower() != "json":
        charset, codec = reader_charset(r.get("encoding"))
        names = _header(_csv_reader(spark, charset, multi_line), location, codec)
    return read_files(spark, [location], r, names, keep_corrupt, multi_line)


def read_files(
    spark: SparkSession,
    locations: Sequence[str],
    resource: Row | Mapping,
    names: Sequence[str] | None,
    keep_corrupt: bool = False,
    multi_line: bool = False,
    file: str | None = None,
) -> DataFrame:
    """Files of one declared schema, charset and header ``names`` as one table.

    Everything is as in ``read_resource``; ``names`` is None for JSON. ``file`` names a
    column that holds the location of each row's file, as (path).
    """
    r = _as_dict(resource)
    declared = r.get("schema") or {}
    fields = declared.get("fields") or []
    missing = declared.get("missingValues")
    charset, codec = reader_charset(r.get("encoding"))
    # a struct is no text of the file, which a charset would change
    extra = [F.struct(F.col("_metadata.file_path").alias("path")).alias(file)] if file else []
    if names is None:
        text = T.StructType([T.StructField(n, T.StringType()) for n in dict.fromkeys(f["name"] for f in fields)])
        whole = T.StructType([*text, T.StructField(CORRUPT, T.StringType())])
        reader = spark.read.schema(whole).option("columnNameOfCorruptRecord", CORRUPT)
        df = reader.json(list(locations), multiLine=True, encoding=charset).select("*", *extra)
        return _cast(df, fields, missing or [""], keep_corrupt, file, F.to_json, F.col(f"`{CORRUPT}`"))
    absent = [f["name"] for f in fields if f["name"] not in names]
    if absent:
        raise ValueError(f"{locations[0]} has no columns {absent}; its header is {list(names)}")
    # columns go by their places: names may be repeated
    place = {f["name"]: list(names).index(f["name"]) for f in fields}
    reader = _csv_reader(spark, charset, multi_line)
    if not missing or missing == [""]:
        kinds = {place[f.name]: f.dataType for f in to_struct(fields)}
        in_file = T.StructType([T.StructField(f"_{i}", kinds.get(i, T.StringType())) for i in range(len(names))])
        if keep_corrupt:
            in_file.add(CORRUPT, "string")
            reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
        df = recode_strings(reader.option("nullValue", "").schema(in_file).csv(list(locations)).select("*", *extra), codec)
        return df.select(
            *[_blank_is_null(f"_{place[f['name']]}", kinds[place[f["name"]]]).alias(f["name"]) for f in fields],
            *([CORRUPT] if keep_corrupt else []),
            *([file] if file else []),
        )
    # several missing values: read as text, blank them, then cast
    text = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(names))])
    df = recode_strings(reader.schema(text).csv(list(locations)).select("*", *extra), codec)
    df = df.withColumnsRenamed({f"_{i}": n for n, i in place.items()})
    return _cast(df, fields, missing, keep_corrupt, file, F.to_csv, None)


def _csv_reader(spark: SparkSession, charset: str, multi_line: bool):
    return (
        spark.read.option("header", True)
        .option("enforceSchema", True)
        .option("encoding", charset)
        .option("mode", "PERMISSIVE")
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
    )


def _blank_is_null(name: str, kind: T.DataType) -> Column:
    """A quoted empty cell is missing, too."""
    return F.nullif(F.col(name), F.lit("")) if isinstance(kind, T.StringType) else F.col(name)


def _cast(
    df: DataFrame, fields: Sequence[Mapping], missing: Sequence[str], keep_corrupt: bool, file: str | None, written, broken: Column | None
) -> DataFrame:
    """Text columns as declared, with what does not fit: ``broken`` lines, else the cells as ``written``."""
    also = [file] if file else []
    if not keep_corrupt:
        return df.select(
            *[cast_cell(F.when(~F.col(f"`{f['name']}`").isin(list(missing)), F.col(f"`{f['name']}`")), f["type"]).alias(f["name"]) for f in fields],
            *also,
        )
    both = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in (file, CORRUPT)]).alias("_text"),
        *[
            F.struct(
                cast_cell(F.when(~F.col(f"`{f['name']}`").isin(list(missing)), F.col(f"`{f['name']}`")), f["type"]).alias("v"),
                (F.col(f"`{f['name']}`").isNull() | F.col(f"`{f['name']}`").isin(list(missing))).alias("gone"),
            ).alias(f"_{i}")
            for i, f in enumerate(fields)
        ],
        (broken if broken is not None else F.lit(None).cast("string")).alias("_broken"),
        *also,
    )
    bad = F.lit(False)
    for i in range(len(fields)):
        bad = bad | (F.col(f"_{i}.v").isNull() & ~F.col(f"_{i}.gone"))
    return both.select(
        *[F.col(f"_{i}.v").alias(f["name"]) for i, f in enumerate(fields)],
        F.coalesce("_broken", F.when(bad, written("_text"))).alias(CORRUPT),
        *also,
    )


def _header(reader, location: str, codec: str | None) -> list[str]:
    """The names in the first line of a file."""
    first = reader.option("header", False).csv(location).limit(1)
    row = recode_strings(first, codec).first()
    return [n or "" for n in row] if row else []


def read_delimited(
    spark: SparkSession,
    leaf: Row | Mapping,
    location: str | None = None,
    infer: bool = True,
    quoted_breaks: bool = False,
    block: int = BLOCK,
) -> DataFrame:
    """A delimited file with a header, as described by an old leaf.

    ``seperator`` (its spelling in leaves), ``comment`` and ``decode`` are taken from
    the leaf. A comment runs from its character, outside quotes, to the end of the
    line; lines that are comments only vanish. With a comment character, or with
    ``quoted_breaks``, files are cut into records by blocks of ``block`` bytes, each in a
    task, and a line break inside quotes is text; the header is the first record over all
    files. Without, lines are records, and every file has a header. Column types are
    inferred from all rows unless ``infer`` is false.
    """
    leaf = _as_dict(leaf)
    location = location or leaf.get("url") or leaf["path"]
    sep, comment = leaf.get("seperator") or ",", leaf.get("comment")
    charset, codec = reader_charset(leaf.get("decode"))
    if comment or quoted_breaks:
        df = _read_records(spark, location, sep, comment, charset, codec, block)
    else:
        df = recode_strings(
            spark.read.csv(
                location, header=True, sep=sep, encoding=charset, quote='"', escape='"', nullValue=""
            ),
            codec,
        )
    if not infer:
        return df
    kinds = {r["column"]: r["type"] for r in infer_types(df, confidence=1.0).collect()}
    fields = [{"name": c, "type": kinds.get(c, "string")} for c in df.columns]
    return cast_declared(df, fields, [""])


def _read_records(
    spark: SparkSession, location: str, sep: str, comment: str | None, charset: str, codec: str | None, block: int
) -> DataFrame:
    """Records cut by ``delimited_records``; the first one over all files is the header."""
    if charset not in ("UTF-8", "ISO-8859-1", "US-ASCII") or len(sep) != 1 or len((comment or "#").encode()) != 1 or not sep.isascii():
        raise ValueError(f"comments and quoted line breaks need a charset and marks of single ASCII bytes, not {charset}, {sep!r}, {comment!r}")
    records, first = delimited_records(spark, location, sep, comment, block)
    text = F.decode("data", charset)
    text = recode(text, codec) if codec else text
    header = first.select("file", "start", text.alias("value")).first()
    if header is None:
        raise ValueError(f"{location} has no header")
    names = next(csv.reader(io.StringIO(header["value"]), delimiter=sep))
    if len(set(names)) < len(names):
        raise ValueError(f"{location} repeats names in its header {names}")
    kinds = ", ".join("`{}` string".format(n.replace("`", "``")) for n in names)
    parsed = F.from_csv(text, kinds, {"sep": sep, "quote": '"', "escape": '"', "nullValue": "", "multiLine": "true", "maxCharsPerColumn": "-1"})
    # the header goes by its place: a record of data may be equal to it
    data = records.where((F.col("file") != header["file"]) | (F.col("start") != header["start"]))
    return data.select(parsed.alias("_r")).select("_r.*")


def read_json_resource(
    spark: SparkSession, leaf: Row | Mapping, location: str | None = None
) -> DataFrame:
    """A JSON resource (an array of records, or records); other formats are refused."""
    leaf = _as_dict(leaf)
    if (leaf.get("format") or "").lower() != "json":
        raise ValueError(f"data file format {leaf.get('format')} is not supported")
    return spark.read.json(location or leaf.get("url") or leaf["path"], multiLine=True)
