"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError, Py4JNetworkError
from pyspark.sql import DataFrame, SparkSession

#: Folders that are deleted at the end of the Python process, with a session that can reach them.
_OPENED: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``.

    Where that is unset, a folder of its own serves a single machine (a ``local`` master, as in tests); on a cluster
    every executor would write to its own disk, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isDefined():
            found = own.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            folder = tempfile.mkdtemp(prefix="loomwright-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            found = "file://" + folder
        else:
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder there that all machines share")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """A folder of this application in the shared one; it goes when the Python process ends."""
    folder = f"{shared_dir(spark)}/loomwright-{spark.sparkContext.applicationId}"
    if folder not in _OPENED:
        if not _OPENED:
            atexit.register(_clean)
        _OPENED[folder] = spark
    return folder


def _clean() -> None:
    for folder, spark in _OPENED.items():
        try:
            delete(spark, folder)
        except (Py4JError, Py4JNetworkError, OSError):
            continue  # the JVM is gone; whoever ended it keeps or deletes its folders


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*frames: DataFrame) -> None:
    """Delete the files of materialized frames that no later step reads."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete(df.sparkSession, path)
