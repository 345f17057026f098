"""Tables in the folder that driver and executors share: lineage ends there, and lost executors lose nothing."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from spindrift.exceptions import LineageError

_MARKED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """This application's own folder below the session's spark.checkpoint.dir; it is deleted when the application ends.

    Only a local session, where driver and executors are one process, may leave the setting out; then it gets a
    temporary folder. On a cluster that would be a folder which others can't see, so that is an error.
    """
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not context.master.startswith("local"):
            raise LineageError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = os.path.join(tempfile.gettempdir(), "checkpoints")
    folder = f"{where}/spindrift-{context.applicationId}"
    if folder not in _MARKED:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
        _MARKED.add(folder)
    return folder


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written as Parquet to the shared folder and read back, and the path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that no later step reads."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
