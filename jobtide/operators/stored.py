"""What is computed once and read several times: written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; one of its own where that is unset and all
    runs on one machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(shared or "file://" + tempfile.mkdtemp(prefix="jobtide-"))
    return context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there is deleted when the interpreter ends."""
    path = f"{folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before the interpreter
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stored(found: DataFrame, by: list[str] | None = None) -> DataFrame:
    """found, computed once and written to the shared folder: what reads it several times does not compute it again, nor after a
    lost executor, and reads the columns that it needs. by: columns of few values, whose rows are read apart.
    """
    path = scratch(found.sparkSession)
    found.write.parquet(path, partitionBy=by)
    return found.sparkSession.read.schema(found.schema).parquet(path)
