"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where spark.checkpoint.dir is unset, as in tests, a local
    session gets a folder of its own; a cluster has none that executors share, so it must say."""
    context = spark.sparkContext
    if (known := context.getCheckpointDir()) is not None:
        return known
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="folioscope-")
    context.setCheckpointDir(where)
    return context.getCheckpointDir()


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared file system, with what is in it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
