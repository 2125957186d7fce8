"""Saving catalogs. Targets are new paths; the table being read is never overwritten."""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import row_key
from ..operators.shape import with_document, with_text
from ..session import stage
from ..sources.files import as_uri, file_system

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def write_catalog(catalog: DataFrame, path: str, overwrite: bool = False) -> None:
    """The catalog as a Parquet table sorted by id, so that id lookups skip row groups."""
    mode = "overwrite" if overwrite else "errorifexists"
    catalog = with_document(catalog)
    catalog.repartitionByRange(*row_key(catalog)).sortWithinPartitions("id").write.mode(mode).parquet(path)


def write_catalog_json(catalog: DataFrame, path: str, overwrite: bool = False) -> None:
    """One descriptor per line in catalog order, keys sorted at every level."""
    mode = "overwrite" if overwrite else "errorifexists"
    lines = with_text(catalog.orderBy("pos"), "value").select("value")
    lines.write.mode(mode).text(path)


def _as_array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of one task as the lines of one JSON array, one line held back."""
    last, opening = None, "["
    for batch in batches:
        lines = []
        for doc in batch["doc"].to_pylist():
            if last is not None:
                lines.append(f"{opening}{last},")
                opening = ""
            last = doc
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
    end = f"{opening}{last}]" if last is not None else "[]"
    yield pa.RecordBatch.from_arrays([pa.array([end])], names=["value"])


def write_catalog_array(
    catalog: DataFrame, path: str, overwrite: bool = False, single_file: bool = False
) -> None:
    """The aggregated form: JSON arrays, in catalog order over the files of ``path``.

    Every task writes one array. ``single_file`` gives the legacy form, one array with
    all datasets, streamed by one task: for small catalogs that other tools read.
    """
    mode = "overwrite" if overwrite else "errorifexists"
    # documents are made after the sort: before it, the sample of its bounds would make them, too
    docs = with_text(catalog.orderBy("pos")).select("doc")
    if single_file:  # made by many tasks, before the one that only strings them together
        made = with_text(catalog).select("pos", "doc")
        docs = stage(made, "documents").orderBy("pos").select("doc").coalesce(1)
    elif catalog.isEmpty():
        docs = docs.repartition(1)  # one task, which writes the empty array
    docs.mapInArrow(_as_array, "value string").write.mode(mode).text(path)


def _write_documents(uri: str, descriptor: str):
    """Task function: one indented file per document, complete under its name or absent."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(uri)
        for batch in batches:
            for id, doc in zip(batch["id"].to_pylist(), batch["doc"].to_pylist()):
                if id in ("", ".", "..") or "/" in id:
                    raise ValueError(f"no folder can be named after the id {id!r}")
                text = json.dumps(json.loads(doc), sort_keys=True, indent=4)
                folder = f"{root}/{id}"
                system.create_dir(folder, recursive=True)
                # object stores show a file when it is closed; others when it is renamed
                rename = isinstance(system, (fs.LocalFileSystem, fs.SubTreeFileSystem))
                target = f"{folder}/{descriptor}"
                draft = f"{folder}/.{uuid.uuid4().hex}" if rename else target
                with system.open_output_stream(draft) as out:
                    out.write(text.encode())
                if rename:
                    system.move(draft, target)
            yield pa.RecordBatch.from_arrays([batch["id"]], names=["id"])

    return write


def export_catalog_dir(
    catalog: DataFrame,
    path: str,
    ids: Sequence[str] | None = None,
    descriptor: str = "dataset.json",
) -> None:
    """One file ``<id>/<descriptor>`` per dataset, indented, keys sorted.

    This is the layout ``read_catalog_dir`` opens. Existing files of the same ids are
    replaced, folders of other ids stay as they are. Tasks write their own documents; a
    task that runs again writes the same files. An id with several rows is an error
    before anything is written.
    """
    if ids is not None:
        catalog = catalog.filter(F.col("id").isin(list(ids)))
    twice = catalog.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").first()
    if twice:
        raise ValueError(f"{twice['n']} rows have the id {twice['id']!r}")
    docs = with_text(catalog).select("id", "doc")
    written = docs.mapInArrow(_write_documents(as_uri(path), descriptor), "id string")
    written.write.format("noop").mode("overwrite").save()


#: Writing some or all documents of a catalog that is there already.
write_catalog_dir = export_catalog_dir


def create_catalog(
    catalog: DataFrame, path: str, overwrite: bool = False, descriptor: str = "dataset.json"
) -> None:
    """Write the documents of a new catalog.

    A target that holds anything is an error, or with ``overwrite`` emptied first.
    """
    system, root = file_system(as_uri(path))
    kind = system.get_file_info(root).type
    if not overwrite and kind != fs.FileType.NotFound and system.get_file_info(fs.FileSelector(root)):
        raise FileExistsError(f"{path} exists already")
    if overwrite and kind == fs.FileType.Directory:
        system.delete_dir_contents(root)
    export_catalog_dir(catalog, path, descriptor=descriptor)
