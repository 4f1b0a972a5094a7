"""Giving disk back while a long chain of steps is still running."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables written by ``cut`` that no later plan reads, and shuffle files of plans that have ended.

    Spark drops the files of a shuffle once the driver's collector finds its plan unreachable, which may
    take long on an idle heap; the collector is asked here. Later tables are files themselves, so a
    lost executor never makes Spark read a deleted one.
    """
    jvm = spark.sparkContext._jvm
    for folder in {file.rsplit("/", 1)[0] for table in tables for file in table.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    jvm.System.gc()
