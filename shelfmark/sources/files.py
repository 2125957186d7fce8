"""File listings.

Spark's own file sources leave out hidden and empty files, so folders are listed
here: level by level, the folders of a level spread over all tasks.
"""

from __future__ import annotations

import datetime
import os
import sys
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import islice
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "path string, folder boolean, size long, mtime timestamp"

_ARROW = pa.schema(
    [
        ("path", pa.string()),
        ("folder", pa.bool_()),
        ("size", pa.int64()),
        ("mtime", pa.timestamp("us", tz="UTC")),
    ]
)

_TEXTS = pa.schema([("path", pa.string()), ("value", pa.string())])


def as_uri(root: str) -> str:
    """A root folder as a URI, as Spark's readers resolve it.

    A path without a scheme, or with one but no host, lies on the file system that the
    cluster has for it; called on the driver.
    """
    root = root.rstrip("/")
    if "://" in root:
        return root
    spark = SparkSession.getActiveSession()
    if spark is None:
        return "file://" + os.path.abspath(root.removeprefix("file:"))
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a root URI, and the root's path in it."""
    scheme, sep, rest = uri.partition("://")
    if scheme == "file":
        return fs.LocalFileSystem(), rest
    return fs.FileSystem.from_uri(("s3" if scheme in ("s3a", "s3n") else scheme) + sep + rest)


def _entries(system: fs.FileSystem, path: str) -> Iterator[dict]:
    """What lies directly in a folder; a mounted folder is streamed."""
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(path) as found:
            for entry in found:
                # links to folders are not followed, links to files are; a dangling one has no size
                try:
                    stat = entry.stat()
                except OSError:
                    stat = None
                if entry.is_symlink() and entry.is_dir():
                    continue
                yield {
                    "path": entry.name,
                    "folder": entry.is_dir(follow_symlinks=False),
                    "size": stat and stat.st_size,
                    "mtime": stat and datetime.datetime.fromtimestamp(stat.st_mtime, datetime.timezone.utc),
                }
    else:
        for info in system.get_file_info(fs.FileSelector(path)):
            yield {
                "path": info.base_name,
                "folder": info.type == fs.FileType.Directory,
                "size": info.size,
                "mtime": info.mtime or datetime.datetime.fromtimestamp(0, datetime.timezone.utc),
            }


def _children(uri: str):
    """Task function: the files and folders directly below each given folder."""

    def list_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(uri)
        for batch in batches:
            for folder in batch["path"].to_pylist():
                entries = _entries(system, f"{root}/{folder}".rstrip("/") or "/")
                while chunk := list(islice(entries, 10_000)):
                    for e in chunk:
                        e["path"] = f"{folder}/{e['path']}".lstrip("/")
                    yield pa.RecordBatch.from_pylist(chunk, schema=_ARROW)

    return list_batches


def list_files(
    spark: SparkSession, root: str, ignore: Sequence[str] = (), glob: str | None = None
) -> DataFrame:
    """(path, size, mtime, uri) of all files below ``root``; contents are not read.

    ``path`` is relative to ``root``. Folders and files named in ``ignore`` are left
    out with everything below them; ``glob`` (with * and ?) selects file names. Each
    level of the tree is one job, written to the shared folder; the driver only learns
    whether there is a next level.
    """
    uri = as_uri(root)
    frontier = spark.range(1).select(F.lit("").alias("path"))
    levels = []
    while True:
        found = frontier.mapInArrow(_children(uri), SCHEMA)
        if ignore:
            found = found.filter(~F.element_at(F.split("path", "/"), -1).isin(list(ignore)))
        level = stage(found, "listing")
        levels.append(level.filter(~F.col("folder")))
        folders = level.filter("folder").select("path")
        if folders.isEmpty():
            break
        frontier = folders.repartition(spark.sparkContext.defaultParallelism, "path")
    files = reduce(DataFrame.union, levels)
    if glob:
        files = files.filter(F.element_at(F.split("path", "/"), -1).like(_like(glob)))
    return files.select("path", "size", "mtime", F.concat(F.lit(uri + "/"), "path").alias("uri"))


def _read_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, held = [], 0
        for path, uri in zip(batch["path"].to_pylist(), batch["uri"].to_pylist()):
            system, place = file_system(uri)
            with system.open_input_stream(place) as file:
                found.append({"path": path, "value": file.read().decode("utf-8", "replace")})
            held += len(found[-1]["value"])
            if held > 1 << 22:  # few large files at a time
                yield pa.RecordBatch.from_pylist(found, schema=_TEXTS)
                found, held = [], 0
        yield pa.RecordBatch.from_pylist(found, schema=_TEXTS)


def read_texts(files: DataFrame) -> DataFrame:
    """(path, value): the whole texts of listed files (path, uri), which the driver never lists.

    For very many small files; they are dealt to a few tasks for each core.
    """
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.select("path", "uri").repartition(4 * cores).mapInArrow(_read_whole, "path string, value string")


def _like(glob: str) -> str:
    for char in ("\\", "%", "_"):
        glob = glob.replace(char, "\\" + char)
    return glob.replace("*", "%").replace("?", "_")


def relative_path(root: str) -> Column:
    """The path below ``root`` of the file a row was read from.

    File names in the metadata column are percent-encoded, as is the root here.
    """
    scheme, _, path = as_uri(root).partition("://")
    marker = (path if scheme == "file" else "/" + path.partition("/")[2]) + "/"
    file = F.col("_metadata.file_path")
    start = F.instr(file, F.lit(quote(marker, safe="/!$&'()*+,;=:@~")))
    encoded = F.substring(file, start + F.lit(len(quote(marker, safe="/!$&'()*+,;=:@~"))), F.length(file))
    return F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))
