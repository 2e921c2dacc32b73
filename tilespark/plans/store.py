"""Intermediate tables in the folder that executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A new place under ``spark.checkpoint.dir``; a local session may go without the setting."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file:///tmp/checkpoints"
    path = f"{folder.rstrip('/')}/tilespark-plan/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df``, written as Parquet and read again."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes all that this process has kept. For when no result that reads it is needed any more."""
    while _written:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop())
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
