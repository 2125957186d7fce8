"""Session settings, and the shared folder for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# the folder of local sessions without a setting, made on first use
_local: dict[str, str] = {}


def session(app: str = "shelfmark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with this package's settings; ``conf`` uses ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    A local session without that setting gets a temporary folder of its own; on a
    cluster a missing setting is an error, as a machine-local folder would be wrong.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or _local.get("dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    _local["dir"] = tempfile.mkdtemp(prefix="shelfmark-")
    return _local["dir"]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The result has no lineage, so values that depend on the physical layout
    (partition ids) stay the same however often a task is run again.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Remove a table that ``stage`` wrote, once nothing that is still to run reads it."""
    spark = df.sparkSession
    top = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file)).getParent()
        # staged tables lie directly in the shared folder; nothing else is touched
        if folder.getParent() and system.makeQualified(folder.getParent()).equals(system.makeQualified(top)):
            system.delete(folder, True)
