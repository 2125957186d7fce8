"""Data files of chosen datasets as Parquet tables, in as few jobs as they have forms."""

from __future__ import annotations

import csv
import io
import json
import posixpath
import sys
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.locate import resolve_paths
from ..operators.lookup import by_ids
from ..operators.position import dense_position
from ..operators.shape import explode_resources
from ..session import stage
from ..sources.files import as_uri, file_system
from ..sources.tables import read_files

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Files of one job; their names are all that the driver and a broadcast hold of them.
FILES_PER_JOB = 10_000


def _head(system: fs.FileSystem, path: str, encoding: str) -> list[str]:
    """The header of a delimited file; only the beginning of the file is fetched."""
    with system.open_input_stream(path) as raw, io.TextIOWrapper(
        io.BufferedReader(raw), encoding=encoding, errors="replace", newline=""
    ) as text:
        return next(csv.reader(text), [])


def _found_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: (number, uri, size, names) of the files at each location, a null uri where there is none."""
    for batch in batches:
        out: list[tuple] = []
        for number, location, format_, encoding in zip(*(batch[c].to_pylist() for c in ("number", "location", "format", "encoding"))):
            scheme = location.partition("://")[0]
            system, path = file_system(location)
            path = posixpath.normpath(path)
            info = system.get_file_info(path)
            if info.type == fs.FileType.Directory:
                inside = system.get_file_info(fs.FileSelector(path, recursive=True))
                # names that Spark's readers leave out are not part of a dataset
                hidden = lambda p: any(s[:1] in "._" for s in p[len(path) :].strip("/").split("/"))
                infos = [i for i in inside if i.type == fs.FileType.File and not hidden(i.path)]
            else:
                infos = [info] if info.type == fs.FileType.File else []
            for i in infos:
                names = None if format_ == "json" else [n or "" for n in _head(system, i.path, encoding)]
                out.append((number, f"{scheme}://{i.path}", i.size, names))
            if not infos:
                out.append((number, None, None, None))
        columns = list(zip(*out)) or [()] * 4
        types = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["number", "uri", "size", "names"])


def _existing(root: str):
    """Task function: which of the tables are there already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = file_system(root)
        for batch in batches:
            there = [system.get_file_info(f"{top}/{t}").type != fs.FileType.NotFound for t in batch["table"].to_pylist()]
            yield batch.select(["table"]).filter(pa.array(there, pa.bool_()))

    return run


def _committed(root: str, staged: str, run_id: str):
    """Task function: every table moved from the staged folder to its name, whole or not at all.

    The files of all jobs are gathered in a hidden folder beside the table, which then
    takes the table's name and place. A task that runs again finds it there. A table
    without rows gets the empty file of its form.
    """

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = file_system(root)
        _, source = file_system(staged)
        for batch in batches:
            files, sizes = [], []
            for number, table, jobs in zip(*(batch[c].to_pylist() for c in ("number", "table", "jobs"))):
                target = f"{top}/{table}"
                parent, _, name = target.rpartition("/")
                draft = f"{parent}/.{name}-{run_id}"
                mark = f"{target}/.run-{run_id}"
                if system.get_file_info(mark).type == fs.FileType.NotFound:
                    system.create_dir(draft, recursive=True)
                    for job in jobs:
                        folder = fs.FileSelector(f"{source}/{job}/_table={number}", allow_not_found=True)
                        for info in system.get_file_info(folder):
                            if info.type == fs.FileType.File:
                                system.move(info.path, f"{draft}/{info.base_name}")
                    if not _parts(system, draft):
                        empty = _parts(system, f"{source}/empty-{jobs[0].partition('-')[0]}")[0]
                        system.copy_file(empty.path, f"{draft}/{empty.base_name}")
                    with system.open_output_stream(f"{draft}/.run-{run_id}"):
                        pass
                    if system.get_file_info(target).type != fs.FileType.NotFound:
                        system.delete_dir(target)
                    system.move(draft, target)
                parts = _parts(system, target)
                files.append(len(parts))
                sizes.append(sum(p.size for p in parts))
            rest = [pa.array(files, pa.int64()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch["number"], *rest], ["number", "n_files", "bytes"])

    return move


def _parts(system: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return [i for i in found if i.type == fs.FileType.File and i.base_name[:1] not in "._"]


def materialize_many(
    catalog: DataFrame,
    ids: Sequence[str] | DataFrame | None,
    dest: str,
    folders: DataFrame,
    base: str,
    refresh: bool = False,
    parallel: int = 8,
    files_per_job: int = FILES_PER_JOB,
) -> DataFrame:
    """Every resource of the chosen datasets (None: of all) saved as ``dest/<id>/<name>``; gives the manifest.

    The manifest has (dataset_id, pos, name, path, table, n_files, bytes), a row for each
    table, and is kept in ``dest/_manifests``. Where resources of a dataset share a name, or
    have none, the position is added to it. Resources that cannot be located (neither
    local nor git), that have no file, and, unless ``refresh``, existing tables are an
    error before anything is written; declared fields that a file lacks are one before
    anything has its name.

    Files of one form (declared schema, charset, header) are one read and one write,
    which deals the rows to their tables; forms of over ``files_per_job`` files are several.
    Headers are read by the tasks. All jobs write to a hidden folder of ``dest``; then
    tasks give the tables their names, and the manifest, written last, says that all
    are there. The driver holds the names of the files of ``parallel`` jobs, nothing else.
    """
    spark = catalog.sparkSession
    root = as_uri(dest)
    chosen = catalog if ids is None else by_ids(catalog, ids)
    where = resolve_paths(chosen, folders, as_uri(base)).select("dataset_id", "pos", "location", "supported")
    same = Window.partitionBy("dataset_id", F.coalesce("name", F.lit("")))
    alone = (F.count("*").over(same) == 1) & (F.coalesce("name", F.lit("")) != "")
    label = F.when(alone, F.col("name")).otherwise(F.concat_ws("-", "name", F.col("pos").cast("string")))
    resources = (
        explode_resources(chosen)
        .join(where, ["dataset_id", "pos"])
        .withColumns({
            "table": F.concat_ws("/", "dataset_id", label),
            "format": F.lower(F.coalesce("format", F.lit("csv"))),
            "encoding": F.coalesce("encoding", F.lit("utf-8")),
        })
    )
    rows = stage(dense_position(resources, ["dataset_id", "pos"], name="number"), "resources")
    lost = rows.filter(~F.col("supported")).select("dataset_id", "path").first()
    if lost:
        raise ValueError(f"{lost['dataset_id']}: {lost['path']} is neither local nor in git")
    twice = rows.groupBy("table").agg(F.count("*").alias("n")).filter("n > 1").first()
    if twice:
        raise ValueError(f"two resources would be saved as {root}/{twice['table']}")
    if not refresh:
        there = rows.select("table").mapInArrow(_existing(root), "table string").first()
        if there:
            raise FileExistsError(f"{root}/{there['table']} exists already")
    spread = rows.select("number", "location", "format", "encoding").repartition(spark.sparkContext.defaultParallelism)
    listed = spread.mapInArrow(_found_files, "number long, uri string, size long, names array<string>")
    form = F.to_json(F.struct("format", "encoding", "names", "schema"))
    files = stage(listed.join(rows.select("number", "format", "encoding", "schema"), "number").withColumn("form", form), "files")
    gone = files.filter(F.col("uri").isNull()).join(rows.select("number", "dataset_id", "path"), "number").first()
    if gone:
        raise FileNotFoundError(f"{gone['dataset_id']}: there is no file {gone['path']}")
    forms = dense_position(files.select("form").distinct(), ["form"], name="group")
    placed = dense_position(files.select("number", "uri", "form"), ["uri", "number"], by=["form"], name="at")
    job = F.concat_ws("-", "group", F.floor(F.col("at") / F.lit(files_per_job)))
    planned = stage(placed.join(forms, "form").select("group", job.alias("job"), "number", "uri", "form"), "jobs")
    run_id = uuid.uuid4().hex
    staged = f"{root}/.staged-{run_id}"
    for jobs in _taken(planned, parallel):
        with ThreadPoolExecutor(parallel) as pool:
            list(pool.map(lambda j: _write(spark, planned, j, f"{staged}/{j}"), jobs))
    _write_empty(spark, planned, staged)
    moved = rows.select("number", "table").join(planned.groupBy("number").agg(F.sort_array(F.collect_set("job")).alias("jobs")), "number")
    moved = stage(moved.mapInArrow(_committed(root, staged, run_id), "number long, n_files long, bytes long"), "moved")
    manifest = f"{root}/_manifests/{run_id}"
    rows.join(moved, "number").select(
        "dataset_id", "pos", "name", "path", F.concat(F.lit(f"{dest.rstrip('/')}/"), "table").alias("table"), "n_files", "bytes"
    ).write.parquet(manifest)
    system, folder = file_system(staged)
    if system.get_file_info(folder).type == fs.FileType.Directory:
        system.delete_dir(folder)
    return spark.read.parquet(manifest)


def _taken(planned: DataFrame, n: int) -> Iterator[list[str]]:
    """The names of the jobs, ``n`` at a time."""
    last = ""
    while True:
        more = planned.where(F.col("job") > last).groupBy("job").agg(F.count("*")).select("job").orderBy("job").limit(n)
        jobs = [r["job"] for r in more.collect()]
        if not jobs:
            return
        yield jobs
        last = jobs[-1]


def _read(spark: SparkSession, form: str, uris: list[str]) -> DataFrame:
    said = json.loads(form)
    resource = {"schema": said.get("schema"), "encoding": said["encoding"], "format": said["format"]}
    return read_files(spark, uris, resource, None if said["format"] == "json" else said.get("names", []), file="_file")


def _write(spark: SparkSession, planned: DataFrame, job: str, target: str) -> None:
    """One job: its files in one read, dealt to their tables by one write."""
    mine: list[Row] = planned.where(F.col("job") == job).select("uri", "number", "form").collect()  # FILES_PER_JOB at most
    rows = _read(spark, mine[0]["form"], sorted({r["uri"] for r in mine}))  # a file may be of several tables
    where = spark.createDataFrame([(r["uri"], r["number"]) for r in mine], "_uri string, _table long")
    uri = F.url_decode(F.replace(F.col("_file.path"), F.lit("+"), F.lit("%2B")))
    uri = F.regexp_replace(uri, "^file:/+", "file:///")  # readers write local files in either way
    lost = F.raise_error(F.concat(F.lit("a file that was not listed: "), uri)).cast("long")
    dealt = rows.join(F.broadcast(where), uri == F.col("_uri"), "left")  # a row for each file of the job
    dealt.withColumn("_table", F.coalesce("_table", lost)).drop("_uri", "_file").write.partitionBy("_table").parquet(target)


def _write_empty(spark: SparkSession, planned: DataFrame, staged: str) -> None:
    """A file without rows for each form that has a table without rows."""
    system, top = file_system(staged)

    def missing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, folder = file_system(staged)
        for batch in batches:
            pairs = zip(batch["jobs"].to_pylist(), batch["number"].to_pylist())
            none = [all(own.get_file_info(f"{folder}/{j}/_table={n}").type == fs.FileType.NotFound for j in jobs) for jobs, n in pairs]
            yield batch.select(["group"]).filter(pa.array(none, pa.bool_()))

    tables = planned.groupBy("number").agg(F.sort_array(F.collect_set("job")).alias("jobs"))
    first = tables.select("number", "jobs", F.split(F.col("jobs")[0], "-")[0].alias("group"))
    groups = stage(first.mapInArrow(missing, "group string").distinct(), "empty")
    forms = stage(planned.select(F.col("group").cast("string").alias("group"), "form", "uri").join(groups, "group").groupBy("group", "form").agg(F.min("uri").alias("uri")), "empty")
    last = ""
    while row := forms.where(F.col("group") > last).orderBy("group").first():
        rows = _read(spark, row["form"], [row["uri"]]).drop("_file").limit(0)
        rows.coalesce(1).write.parquet(f"{staged}/empty-{row['group']}")
        last = row["group"]


def materialize(
    catalog: DataFrame,
    ids: Sequence[str],
    dest: str,
    folders: DataFrame,
    base: str,
    refresh: bool = False,
    parallel: int = 8,
) -> list[str]:
    """``materialize_many`` for a few datasets; returns the paths of the tables written, in order."""
    manifest = materialize_many(catalog, list(ids), dest, folders, base, refresh, parallel)
    return [r["table"] for r in manifest.orderBy("dataset_id", "pos").select("table").collect()]
