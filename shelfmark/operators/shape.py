"""Projections of catalogs: typed columns, resources, fields, entries, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.flatten import with_entries
from ..schema import CONTRIBUTORS, DATAPACKAGE, DATASET_TEXT

# The rows of the summary, as (label, column).
SUMMARY = {
    "ID": "id",
    "Name": "name",
    "Source": "source",
    "Description": "description",
    "URI": "uri",
    "Metadata": "metadata_uri",
}
SITE_SUMMARY = {
    "Name": "name",
    "Dataset ID": "id",
    "Source Type": "source",
    "URI": "uri",
    "Metadata URI": "metadata_uri",
    "Category": "category",
    "Tags": "tags",
}


def _get(raw: Column, key: str, kind: str) -> Column:
    return F.try_variant_get(raw, f"$.{key}", kind)


def _typed(doc: Column) -> dict[str, Column]:
    """The typed columns of a descriptor."""
    text = {n: _get(doc, n, "string") for n in DATASET_TEXT}
    for name in ("id", "metadata_uri"):
        text[name] = F.coalesce(text[name], F.lit(""))
    single = _get(doc, "tags", "string")
    return {
        **text,
        "tags": F.coalesce(_get(doc, "tags", "array<string>"), F.when(single.isNotNull(), F.array(single))),
        "contributors": _get(doc, "contributors", CONTRIBUTORS.simpleString()),
        "datapackage": _get(doc, "datapackage", DATAPACKAGE.simpleString()),
    }


def normalize(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Typed columns of a descriptor held in a VARIANT column; other columns stay.

    ``id`` and ``metadata_uri`` default to the empty text. ``tags`` may be a list or
    a single text; a text becomes a list of one.
    """
    return df.withColumns(_typed(F.col(raw)))


def _in_order(value: Column, kind: T.DataType) -> Column:
    """A nested value with the fields of its records in the order of their names."""
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.ArrayType, T.StructType)):
        return F.transform(value, lambda x: _in_order(x, kind.elementType))
    if isinstance(kind, T.StructType):
        fields = [_in_order(value[f.name], f.dataType).alias(f.name) for f in sorted(kind, key=lambda f: f.name)]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def _made(catalog: DataFrame) -> tuple[Column, Column]:
    """(does a typed column of the row hold anything, the document that they make as JSON text)."""
    names = sorted(n for n in (*DATASET_TEXT, "tags", "contributors", "datapackage") if n in catalog.columns)
    said = reduce(Column.__or__, [F.col(n).isNotNull() for n in names], F.lit(False))
    values = [F.col(n).cast("string") if n in DATASET_TEXT else _in_order(F.col(n), catalog.schema[n].dataType) for n in names]
    if not names:
        return said, F.lit("{}")
    return said, F.to_json(F.struct(*[v.alias(n) for n, v in zip(names, values)]), {"ignoreNullFields": "true"})


def with_text(catalog: DataFrame, name: str = "doc") -> DataFrame:
    """The catalog with its whole documents as JSON text, keys sorted at every level.

    Where columns make the document it is written from them: the text of a VARIANT costs
    several times as much.
    """
    have = F.col("raw") if "raw" in catalog.columns else F.lit(None).cast("variant")
    said, text = _made(catalog)
    direct = catalog.withColumn("_made", have.isNull() & said)
    return with_document(direct).withColumn(name, F.when(F.col("_made"), text).otherwise(F.to_json("raw"))).drop("_made")


def with_document(catalog: DataFrame) -> DataFrame:
    """The catalog with a whole document in ``raw``: typed columns flow back into it.

    A key whose typed column says the same as the document stays as it is written,
    with all that the typed column does not hold. A changed one is replaced, or
    left out if it is null. Rows without a document get one from their typed columns;
    a row that has neither is an error when it is written.
    """
    have = F.col("raw") if "raw" in catalog.columns else F.lit(None).cast("variant")
    old = {n: c for n, c in _typed(have).items() if n in catalog.columns}
    new = {n: F.col(n).cast("string") if n in DATASET_TEXT else F.col(n) for n in old}
    none = F.raise_error(F.lit("a row without a document cannot be written")).cast("variant")
    said, text = _made(catalog)
    made = F.when(said, F.parse_json(text)).otherwise(none)
    if "raw" not in catalog.columns or not old:
        return catalog.withColumn("raw", F.when(have.isNotNull(), have).otherwise(made))
    changed, values = [], []
    for name in old:
        if name in DATASET_TEXT:
            same, value = new[name].eqNullSafe(old[name]), new[name].cast("variant")
        else:
            same, value = F.to_json(new[name]).eqNullSafe(F.to_json(old[name])), F.parse_json(F.to_json(new[name]))
        # a default is no change of a document that lacks the key
        same = same | (new[name].isNull() & old[name].isNull())
        changed.append(F.when(have.isNotNull() & ~same, name))
        values.append(F.struct(F.lit(name).alias("key"), value.alias("value")))
    # in a column of its own, or documents and columns would be compared again for each of their keys
    compared = catalog.withColumn("_changed", F.array(*changed))
    keys = F.array_compact("_changed")
    edits = F.filter(F.array(*values), lambda e: F.array_contains(keys, e["key"]) & e["value"].isNotNull())
    top = F.coalesce(F.try_variant_get(have, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    merged = F.map_concat(F.map_filter(top, lambda k, v: ~F.array_contains(keys, k)), F.map_from_entries(edits))
    document = F.when(have.isNull(), made).when(F.size(keys) == 0, have).otherwise(F.to_variant_object(merged))
    return compared.withColumn("raw", document).drop("_changed")


def _inner(exploded: DataFrame, pos: str) -> DataFrame:
    """Drop the rows an outer explode adds for empty arrays.

    An inner explode makes Catalyst infer a filter on the array's size; where the
    array is parsed from a descriptor, that filter parses it once more.
    """
    return exploded.filter(F.col(pos).isNotNull())


def explode_resources(catalog: DataFrame, outer: bool = False) -> DataFrame:
    """One row per resource, with its position; ``outer`` keeps datasets without any."""
    out = catalog.select(
        F.col("id").alias("dataset_id"),
        F.posexplode_outer("datapackage.resources").alias("pos", "resource"),
    )
    if not outer:
        out = _inner(out, "pos")
    return out.select("dataset_id", F.col("pos").cast("long").alias("pos"), "resource.*")


def explode_fields(catalog: DataFrame, outer: bool = False) -> DataFrame:
    """One row per declared field of every resource."""
    fields = explode_resources(catalog, outer).select(
        "dataset_id",
        F.col("pos").alias("resource_pos"),
        F.col("name").alias("resource"),
        F.posexplode_outer("schema.fields").alias("field_pos", "field"),
    )
    if not outer:
        fields = _inner(fields, "field_pos")
    return (
        fields.select(
            "dataset_id",
            "resource_pos",
            "resource",
            F.col("field_pos").cast("long").alias("field_pos"),
            F.col("field.name").alias("field"),
            F.col("field.type").alias("type"),
            F.col("field.format").alias("format"),
        )
    )


def flatten(
    df: DataFrame, col: str, id_cols: tuple[str, ...] = ("id",), sep: str = "__", max_depth: int = 8
) -> DataFrame:
    """(ids, key, value) of every leaf of a nested record, VARIANT or JSON text.

    Keys of objects and positions in lists are joined by ``sep``; empty objects and
    lists vanish.
    """
    value = F.col(col)
    if dict(df.dtypes)[col] == "string":
        value = F.try_parse_json(value)
    found = with_entries(df.select(*id_cols, value.alias("_value")), F.col("_value"), "_entries", sep, max_depth)
    rows = _inner(found.select(*id_cols, F.posexplode_outer("_entries").alias("_n", "_e")), "_n")
    return rows.select(
        *id_cols, F.coalesce("_e.key", F.lit("")).alias("key"), F.col("_e.value").alias("value")
    )


def summary(catalog: DataFrame, site: bool = False) -> DataFrame:
    """(id, key, value) rows of the dataset summary."""
    rows = SITE_SUMMARY if site else SUMMARY
    text = {
        label: F.array_join(col, ", ") if col == "tags" else F.col(col) for label, col in rows.items()
    }
    wide = catalog.select(F.col("id").alias("_id"), *[c.alias(label) for label, c in text.items()])
    return wide.unpivot(["_id"], list(rows), "key", "value").withColumnRenamed("_id", "id")


def resource_tree(catalog: DataFrame) -> DataFrame:
    """(id, paths) with the paths of a dataset's resources in order."""
    return catalog.select(
        "id",
        F.coalesce(
            F.transform("datapackage.resources", lambda r: r.path), F.array().cast("array<string>")
        ).alias("paths"),
    )


def describe(catalog: DataFrame, label: str = "Dataset ID") -> DataFrame:
    """(id, line): id, name, description and the contributors' names as one text."""
    people = F.array_join(F.transform("contributors", lambda c: c["name"]), ", ")
    return catalog.select(
        "id",
        F.concat(
            F.lit(f"{label}: "),
            F.coalesce("id", F.lit("")),
            F.lit("\nname: "),
            F.coalesce("name", F.lit("")),
            F.lit("\ndescription: "),
            F.coalesce("description", F.lit("")),
            F.lit("\ncontributors: "),
            F.coalesce(people, F.lit("")),
        ).alias("line"),
    )


def full_metadata(catalog: DataFrame, raw: str = "raw") -> DataFrame:
    """(id, metadata): the whole descriptor as JSON, keys sorted at every level."""
    return catalog.select("id", F.to_json(raw).alias("metadata"))
