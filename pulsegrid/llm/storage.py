"""Where intermediate tables go: the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session.

    Where it is unset a temporary folder is taken on a master that runs in one process,
    as in tests; on any other master that is an error, for executors could not see it."""
    held = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        held = "file://" + tempfile.mkdtemp(prefix="pulsegrid-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(held)
    return held


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that is removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    files, at = _file_system(spark, path)
    files.makeQualified(at)
    files.deleteOnExit(at)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder, with its lineage cut."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Removes tables that ``written`` made and that nothing reads any more."""
    for table in tables:
        if path := getattr(table, "stored_at", None):
            files, at = _file_system(table.sparkSession, path)
            files.delete(at, True)
