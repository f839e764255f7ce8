"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local one is set only where a local session names none."""
    folder = spark.conf.get(_SETTING, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"{_SETTING} must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="aeolith-")
        spark.conf.set(_SETTING, folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder and read back: lineage ends here, and lost executors lose none of it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    was = spark.conf.get(_CLEANUP, None)
    # once the table is written, nothing reads the shuffle files behind it
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if was is None else spark.conf.set(_CLEANUP, was)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table made by stored() that no plan reads any more."""
    path = getattr(df, "_stored_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def collect_garbage(spark: SparkSession) -> None:
    """Frees what the driver still holds of ended jobs: Spark drops their broadcasts, shuffles and compiled plans only once they are collected.

    For queries of many jobs: the driver's heap else grows to its limit first, and its memory outside the heap beyond that.
    """
    spark._jvm.System.gc()
