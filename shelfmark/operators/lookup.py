"""Lookup of datasets, resources and folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.flatten import entries, with_entries

# The keys a search looks into by default.
SEARCH_KEYS = ("name", "id", "repository", "tags", "description")

# Typed text columns that a key of the same name can be read from.
_TYPED = ("name", "id", "repository", "description", "source", "uri", "metadata_uri", "category")

# Folder names left out of listings. A descriptor folder is named after
# the descriptor file, see ``ignored_names``.
IGNORED = (".git", ".vscode")


def ignored_names(descriptor: str = "dataset.json") -> tuple[str, ...]:
    return (*IGNORED, "." + descriptor.rsplit(".", 1)[0])


def by_ids(catalog: DataFrame, ids: Sequence[str] | DataFrame) -> DataFrame:
    """Rows whose id is one of ``ids``: a list, or a table with a column ``id``."""
    if isinstance(ids, DataFrame):
        return catalog.join(ids.select("id"), "id", "left_semi").select(catalog.columns)
    return catalog.filter(F.col("id").isin(list(ids)))


def by_id_contained(catalog: DataFrame, text: str) -> DataFrame:
    """Legacy rule: rows whose id is a part of ``text`` (the empty id always is)."""
    return catalog.filter(F.lit(text).contains(F.coalesce("id", F.lit(""))))


def get_dataset(catalog: DataFrame, id: str) -> DataFrame:
    """The first dataset with this id, or no row."""
    return catalog.filter(F.col("id") == id).orderBy("pos").limit(1)


def select_resource(
    source: DataFrame,
    idx: int | None = None,
    path: str | None = None,
    name: str | None = None,
    report_missing: bool = False,
) -> DataFrame:
    """Per dataset, the first resource at a position, else with a path, else with a name.

    ``source`` is a catalog, where the choice is made inside each row without a
    shuffle, or an exploded table of resources. With ``report_missing`` a dataset
    without a match stays, with ``found`` false and null columns.
    """
    if idx is not None:
        key, value = "pos", idx
    elif path:
        key, value = "path", path
    elif name:
        key, value = "name", name
    else:
        raise ValueError("give one of idx, path, name")
    if "datapackage" in source.columns:
        return _select_in_row(source, key, value, report_missing)
    match = F.col(key) == value
    rest = [c for c in source.columns if c != "dataset_id"]
    rows = source if report_missing else source.filter(match)
    first = F.min_by(F.when(match, F.struct(*rest)), F.when(match, F.col("pos")))
    return (
        rows.groupBy("dataset_id")
        .agg(first.alias("_r"))
        .select("dataset_id", "_r.*", F.col("_r").isNotNull().alias("found"))
    )


def _select_in_row(
    catalog: DataFrame, key: str, value: int | str, report_missing: bool
) -> DataFrame:
    def numbered(r: Column, i: Column) -> Column:
        return F.struct(i.cast("long").alias("pos"), r.alias("r"))

    def matches(c: Column) -> Column:
        return (c["pos"] if key == "pos" else c["r"][key]) == value

    chosen = F.get(F.filter(F.transform("datapackage.resources", numbered), matches), F.lit(0))
    # outer: an inner explode would evaluate the choice once more, for a filter
    rows = catalog.select(
        F.col("id").alias("dataset_id"), F.explode_outer(F.array(chosen)).alias("_c")
    ).select("dataset_id", "_c.pos", "_c.r.*", F.col("_c").isNotNull().alias("found"))
    return rows if report_missing else rows.filter("found")


def search_values(catalog: DataFrame, keys: Sequence[str] = SEARCH_KEYS) -> tuple[DataFrame, Column]:
    """The catalog and an array column with all texts under ``keys``.

    Typed columns are used where they exist, so that a default search never reads
    ``raw``; other keys are flattened from ``raw``. A typed text that is the JSON of an
    object or a list, which a nested value becomes, counts with its leaves.
    """
    have = set(catalog.columns)
    typed = [F.col(k) for k in keys if k in _TYPED and k in have]
    parts = [F.array(*typed)] if typed else []
    if "tags" in keys and "tags" in have:
        parts.append(F.coalesce("tags", F.array().cast("array<string>")))
    if parts:
        parts = [_leaves(F.concat(*parts))]
    other = [k for k in keys if k not in have or (k not in _TYPED and k != "tags")]
    if other and "raw" in have:
        top = F.try_variant_get(F.col("raw"), "$", "map<string,variant>")
        chosen = F.map_filter(top, lambda k, v: k.isin(other))
        nested = F.to_variant_object(chosen)
        catalog = with_entries(catalog, nested, "_texts", max_depth=4)
        parts.append(F.coalesce(F.transform("_texts", lambda e: e.value), F.array().cast("array<string>")))
    if not parts:
        return catalog, F.array().cast("array<string>")
    return catalog, F.array_compact(F.concat(*parts))


def _nested(text: Column) -> Column:
    """The value of a text that is the JSON of an object or a list, else null."""
    return F.when(text.rlike(r"^\s*[{\[]"), F.try_parse_json(text))


def _leaves(texts: Column) -> Column:
    """Texts, with the leaves of nested values in their place. Rows without any are left as they are."""
    flat = F.filter(texts, lambda t: _nested(t).isNull())
    inner = F.transform(F.filter(texts, lambda t: _nested(t).isNotNull()), _nested)
    some = F.exists(F.coalesce(texts, F.array().cast("array<string>")), lambda t: F.coalesce(t.rlike(r"^\s*[{\[]"), F.lit(False)))
    # below eight levels a value counts as one text
    values = F.transform(
        entries(F.to_variant_object(inner), "__", 8),
        lambda e: F.coalesce(F.try_variant_get(e.value, "$", "string"), F.to_json(e.value)),
    )
    return F.when(some, F.concat(flat, values)).otherwise(texts)


def search_fields(catalog: DataFrame, keys: Sequence[str] = SEARCH_KEYS, sep: str = "__") -> DataFrame:
    """(id, pos, key, value) of the texts a search looks into."""
    have = set(catalog.columns)
    typed = [k for k in keys if k in have and (k in _TYPED or k == "tags")]

    def variant(k: str) -> Column:
        if k != "tags":
            return F.coalesce(_nested(F.col(k)), F.col(k).cast("string").cast("variant"))
        each = F.transform("tags", lambda t: F.coalesce(_nested(t), t.cast("variant")))
        return F.when(F.col("tags").isNotNull(), F.to_variant_object(each))

    record = [F.when(F.col(k).isNotNull(), F.struct(F.lit(k).alias("key"), variant(k).alias("value"))) for k in typed]
    value = F.to_variant_object(F.map_from_entries(F.array_compact(F.array(*record)))) if typed else F.parse_json(F.lit("{}"))
    other = [k for k in keys if k not in typed]
    if other and "raw" in have:
        top = F.try_variant_get(F.col("raw"), "$", "map<string,variant>")
        chosen = F.map_filter(top, lambda k, v: k.isin(other))
        mine = F.try_variant_get(value, "$", "map<string,variant>")
        value = F.to_variant_object(F.map_concat(mine, F.coalesce(chosen, F.create_map().cast("map<string,variant>"))))
    found = with_entries(
        catalog.select("id", "pos", value.alias("_v")), F.col("_v"), "_e", sep, max_depth=4
    )
    rows = found.select("id", "pos", F.posexplode_outer("_e").alias("_n", "_e"))
    return rows.filter(F.col("_n").isNotNull()).select("id", "pos", "_e.key", "_e.value")


def filter_report(report: DataFrame, level: str | None = "warning") -> DataFrame:
    """Report rows by severity.

    ``warning`` shows warnings and errors, ``error`` errors only, ``all`` successes
    only; None shows every row.
    """
    shown = {"warning": ["warning", "error"], "error": ["error"], "all": ["success"]}
    if level is None:
        return report
    if level not in shown:
        raise ValueError(f"level must be one of {sorted(shown)} or None")
    return report.filter(F.col("status").isin(shown[level]))


def list_folders(files: DataFrame, ignored: Sequence[str] = ignored_names()) -> DataFrame:
    """Folders above the listed files, without ignored names and hidden roots.

    Parents are made distinct before their ancestors are unfolded, so a folder with
    many files is shuffled as one row per task.
    """
    parents = files.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("p")).distinct()
    steps = F.split("p", "/")
    return (
        parents.filter(F.col("p") != "")
        .select(
            F.explode(
                F.transform(
                    F.sequence(F.lit(1), F.size(steps)),
                    lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"),
                )
            ).alias("folder")
        )
        .distinct()
        .filter(
            ~F.element_at(F.split("folder", "/"), -1).isin(list(ignored))
            & ~F.col("folder").startswith(".")
        )
    )
