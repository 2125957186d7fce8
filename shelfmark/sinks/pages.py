"""Catalog pages: front matter documents for a site generator."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, list_block, slug
from ..operators.joins import salted_lookup
from ..operators.position import dense_position
from ..sources.files import as_uri, file_system

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _full() -> Column:
    """The whole descriptor plus ``title``, as JSON (which is valid YAML)."""
    top = F.try_variant_get("raw", "$", "map<string,variant>")
    title = F.create_map(F.lit("title"), F.variant_get("raw", "$.name", "variant"))
    merged = F.map_concat(F.map_filter(top, lambda k, v: k != "title"), title)
    return F.concat(F.lit("---\n"), F.to_json(F.to_variant_object(merged)), F.lit("\n---\n  "))


def _short() -> Column:
    """Title, description, keywords and category."""
    return F.concat(
        F.lit('---\ntitle: "'),
        F.coalesce("name", F.lit("")),
        F.lit('"\n'),
        F.when(blank(F.col("description")), "").otherwise(
            F.concat(F.lit('description: "'), "description", F.lit('"\n'))
        ),
        F.coalesce(list_block(F.col("tags"), "keywords"), F.lit("")),
        F.when(blank(F.col("category")), "").otherwise(
            F.concat(F.lit("category: "), "category", F.lit("\n"))
        ),
        F.lit("---\n  "),
    )


def render_pages(catalog: DataFrame, style: str = "full") -> DataFrame:
    """(id, slug, page): one document per dataset, ``full`` or ``short``."""
    if style not in ("full", "short"):
        raise ValueError("style must be full or short")
    return catalog.select(
        "id", slug(F.col("id")).alias("slug"), (_full() if style == "full" else _short()).alias("page")
    )


def _write_files(uri: str, extension: str):
    """Task function: one file per page, complete under its name or absent."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(uri)
        system.create_dir(root, recursive=True)
        rename = isinstance(system, (fs.LocalFileSystem, fs.SubTreeFileSystem))
        for batch in batches:
            for name, page in zip(batch["file"].to_pylist(), batch["page"].to_pylist()):
                target = f"{root}/{name}{extension}"
                draft = f"{root}/.{uuid.uuid4().hex}" if rename else target
                with system.open_output_stream(draft) as out:
                    out.write(page.encode())
                if rename:
                    system.move(draft, target)
            yield pa.RecordBatch.from_arrays([batch["file"]], names=["file"])

    return write


def write_pages(pages: DataFrame, path: str, overwrite: bool = False, extension: str = ".md") -> None:
    """One file ``<slug>.md`` per page, for a site generator.

    Pages that share a slug are numbered by id, ``<slug>--0.md`` and so on (a slug has no
    two dashes in a row), so none is lost; an empty slug is ``index``. A target that holds
    anything is an error, or with ``overwrite`` emptied first.
    """
    system, root = file_system(as_uri(path))
    kind = system.get_file_info(root).type
    if kind == fs.FileType.Directory and system.get_file_info(fs.FileSelector(root)):
        if not overwrite:
            raise FileExistsError(f"{path} exists already")
        system.delete_dir_contents(root)
    slug_ = F.when(F.coalesce("slug", F.lit("")) == "", "index").otherwise(F.col("slug"))
    named = pages.select(slug_.alias("slug"), "id", "page")
    shared = named.groupBy("slug").agg(F.count("*").alias("n")).filter("n > 1")
    counted = salted_lookup(named, shared, "slug", ["id", "page"])
    alone = counted.filter(F.col("n").isNull()).select(F.col("slug").alias("file"), "page")
    many = dense_position(counted.filter(F.col("n").isNotNull()).drop("n"), ["id", "page"], by=["slug"], name="at")
    files = alone.unionByName(many.select(F.concat_ws("--", "slug", "at").alias("file"), "page"))
    # small rows lie in few splits, but a file costs far more than moving its row
    dealt = files.repartition(4 * files.sparkSession.sparkContext.defaultParallelism, "file")
    written = dealt.mapInArrow(_write_files(as_uri(path), extension), "file string")
    written.write.format("noop").mode("overwrite").save()
