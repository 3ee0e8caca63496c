"""Tables and intermediate results in the folder that all executors share."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no checkpoint folder and runs on one machine, as in tests.
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints/keyloom"
#: What each thread of the driver has written, until it is dropped: what one thread makes no other one deletes.
_local = threading.local()


def _written() -> list[str]:
    if not hasattr(_local, "paths"):
        _local.paths = []
    return _local.paths


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a local one on a local master; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = LOCAL_CHECKPOINTS
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Lineage ends here, so a lost executor costs no recomputation of what came before,
    and later passes read the columns they need instead of repeating the work.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    _written().append(path)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever it is; what is not there is no error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def n_written() -> int:
    """How many tables of this thread are there; a mark for ``drop_written``."""
    return len(_written())


def drop_written(spark: SparkSession, since: int = 0, keep_last: bool = False) -> None:
    """Deletes what this thread has written by ``cut`` since the mark ``since``, but for the last table, if asked. Only for what no result
    is still read from."""
    paths = _written()
    end = len(paths) - keep_last
    for path in paths[since:end]:
        drop(spark, path)
    del paths[since:end]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
