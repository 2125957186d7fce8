"""One object for the usual steps: open, search, look up, change, save."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from .operators import lookup, mutate, shape
from .operators import search as searching
from .operators.locate import resolve_paths
from .sinks.catalogs import (
    create_catalog,
    write_catalog,
    write_catalog_array,
    write_catalog_json,
)
from .sources.catalogs import read_catalog, read_catalog_dir, read_catalog_json, read_catalog_lines
from .sources.tables import read_resource


class Catalog:
    """A catalog table. Changes return a new Catalog; nothing is saved until ``save``."""

    def __init__(self, datasets: DataFrame):
        self.datasets = datasets

    @classmethod
    def open(
        cls, spark: SparkSession, path: str, layout: str = "table", descriptor: str = "dataset.json"
    ) -> Catalog:
        """``layout``: table (Parquet), dir, json (one array) or lines (JSON Lines)."""
        if layout == "dir":
            return cls(read_catalog_dir(spark, path, descriptor))
        readers = {"table": read_catalog, "json": read_catalog_json, "lines": read_catalog_lines}
        return cls(readers[layout](spark, path))

    def search(self, keywords: searching.Keywords, **options) -> DataFrame:
        return searching.search(self.datasets, keywords, **options)

    def get(self, id: str) -> DataFrame:
        return lookup.get_dataset(self.datasets, id)

    def by_ids(self, ids: Sequence[str] | DataFrame) -> DataFrame:
        return lookup.by_ids(self.datasets, ids)

    def metadata(self, id: str) -> dict | None:
        """The whole descriptor of a dataset, or None."""
        row = self.get(id).select("raw").first()
        return row["raw"].toPython() if row else None

    def resources(self, id: str | None = None) -> DataFrame:
        return shape.explode_resources(self.get(id) if id is not None else self.datasets)

    def read(
        self,
        id: str,
        folders: DataFrame,
        base: str,
        idx: int | None = None,
        path: str | None = None,
        name: str | None = None,
    ) -> DataFrame:
        """A data file of a dataset under its declared schema.

        ``folders`` (column ``id``) tells which datasets have a folder below ``base``.
        """
        dataset = self.get(id)
        chosen = lookup.select_resource(dataset, idx, path, name)
        where = resolve_paths(dataset, folders, base).select("dataset_id", "pos", "location")
        row = chosen.join(where, ["dataset_id", "pos"]).first()
        if row is None:
            raise LookupError(f"no such resource in {id}")
        return read_resource(self.datasets.sparkSession, row)

    def add(self, new: DataFrame) -> tuple[Catalog, DataFrame]:
        """(catalog with the accepted datasets, rejected rows)."""
        catalog, rejected = mutate.add(self.datasets, new)
        return Catalog(catalog), rejected

    def remove(self, ids: Sequence[str] | DataFrame) -> Catalog:
        return Catalog(mutate.remove(self.datasets, ids))

    def replace(self, new: DataFrame) -> Catalog:
        return Catalog(mutate.upsert(self.datasets, new))

    def save(self, path: str, layout: str = "table", overwrite: bool = False) -> None:
        """To a new path; the path this catalog was read from must not be the target.

        ``layout``: table, lines, json (arrays) or dir (``<id>/dataset.json``).
        """
        if layout == "dir":
            create_catalog(self.datasets, path, overwrite)
        elif layout == "json":
            write_catalog_array(self.datasets, path, overwrite)
        elif layout == "lines":
            write_catalog_json(self.datasets, path, overwrite)
        elif layout == "table":
            write_catalog(self.datasets, path, overwrite)
        else:
            raise ValueError("layout must be table, lines, json or dir")
