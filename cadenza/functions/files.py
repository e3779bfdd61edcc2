"""The file system of a path, as Spark sees it."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def filesystem(spark: SparkSession, path: str):
    """The file system that holds `path`, and a function that makes its paths."""
    jvm = spark.sparkContext._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share (`spark.checkpoint.dir`).  Only a local session may fall back to a temporary one."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given is None:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        given = tempfile.mkdtemp(prefix="cadenza-checkpoints-")
    context.setCheckpointDir(given)
    return context._jsc.sc().getCheckpointDir().get()
