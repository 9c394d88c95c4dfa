"""The folder for checkpoints and written tables: the one that the session shares among executors; in local mode
without one, a folder of this process that goes when it ends."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints; a local one only where all executors are local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isEmpty():
            return current.get()
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="tickframe-"))
            atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
        folder = _LOCAL[0]
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in files of the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
