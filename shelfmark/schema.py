"""Canonical schema of catalogs, and declared field types against Spark types."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import types as T

FIELD = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "type", "format")])

TABLE_SCHEMA = T.StructType(
    [
        T.StructField("fields", T.ArrayType(FIELD)),
        T.StructField("missingValues", T.ArrayType(T.StringType())),
    ]
)

RESOURCE_TEXT = ("name", "path", "format", "mediatype", "encoding", "profile")

RESOURCE = T.StructType(
    [T.StructField(n, T.StringType()) for n in RESOURCE_TEXT]
    + [T.StructField("schema", TABLE_SCHEMA)]
)

DATAPACKAGE = T.StructType(
    [T.StructField("profile", T.StringType()), T.StructField("resources", T.ArrayType(RESOURCE))]
)

CONTRIBUTORS = T.ArrayType(
    T.StructType([T.StructField("name", T.StringType()), T.StructField("github", T.StringType())])
)

DATASET_TEXT = (
    "id", "name", "description", "repository", "source", "uri", "metadata_uri", "category",
)

DATASET = T.StructType(
    [T.StructField("pos", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in DATASET_TEXT]
    + [
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("contributors", CONTRIBUTORS),
        T.StructField("datapackage", DATAPACKAGE),
        T.StructField("raw", T.VariantType()),
    ]
)

LEAF_FIELD = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "description")])

LEAF = T.StructType(
    [
        T.StructField("dataset_id", T.StringType()),
        T.StructField("pos", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("format", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("updated_at", T.StringType()),
        T.StructField("fields", T.ArrayType(LEAF_FIELD)),
    ]
)

# Type names of the data-package standard and the Spark type of each.
SPARK_TYPES = {
    "string": T.StringType(),
    "integer": T.LongType(),
    "number": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "datetime": T.TimestampType(),
    "time": T.StringType(),
    "year": T.IntegerType(),
    "object": T.VariantType(),
    "array": T.VariantType(),
    "any": T.StringType(),
}


def spark_type(declared: str | None, number: T.DataType | None = None) -> T.DataType:
    """Spark type of a declared type; ``number`` may be given as a decimal type."""
    if declared == "number" and number is not None:
        return number
    return SPARK_TYPES.get(declared or "string", T.StringType())


def to_struct(fields: Iterable[Mapping], number: T.DataType | None = None) -> T.StructType:
    """Declared fields (dicts or Rows) as the StructType to read a file with."""
    return T.StructType(
        [T.StructField(f["name"], spark_type(f["type"], number)) for f in fields]
    )


def declared_type(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.IntegralType):
        return "integer"
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, T.DateType):
        return "date"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(dtype, T.ArrayType):
        return "array"
    if isinstance(dtype, (T.StructType, T.MapType, T.VariantType)):
        return "object"
    return "string"


def to_fields(struct: T.StructType) -> list[dict]:
    """The declared form of a Spark schema."""
    return [
        {"name": f.name, "type": declared_type(f.dataType), "format": "default"} for f in struct
    ]
