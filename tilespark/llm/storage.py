"""Tables that cut lineage: written as Parquet to the folder that all executors share, then read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_FALLBACK = "/tmp/checkpoints"
#: Rows go to Python in batches of about this size, so a run of long texts can't fill a worker or the JVM's buffers.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only a local session may go without one."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{LOCAL_FALLBACK}"


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's limit for a batch to ``BATCH_BYTES``, unless it is lower."""
    now = spark.conf.get(BATCH_SETTING).rstrip("bB")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tilespark/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once. A lost executor costs no recomputation of what came before."""
    bounded_batches(df.sparkSession)
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes a staged table that no later plan reads."""
    _written.remove(df.staged_path)
    dropped(df.sparkSession, df.staged_path)


def mark() -> int:
    """Stands for all that is staged so far; see ``settled``."""
    return len(_written)


def settled(df: DataFrame, since: int) -> DataFrame:
    """The staged table ``df``; all others staged since the mark are deleted, as only it was made from them."""
    for path in [p for p in _written[since:] if p != df.staged_path]:
        _written.remove(path)
        dropped(df.sparkSession, path)
    return df


def clear(spark: SparkSession) -> None:
    """Deletes all staged tables of this process. For when no result that reads them is needed any more."""
    while _written:
        dropped(spark, _written.pop())


def dropped(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
