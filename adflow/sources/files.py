"""The few file system calls that table maintenance needs, through the Hadoop file
system of the path (so any store that Spark reads)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    folder, fs = _path(spark, path)
    return fs.exists(folder)


def children(spark: SparkSession, path: str) -> list[str]:
    """Paths of the folders and files directly under ``path``; none if it does not exist."""
    folder, fs = _path(spark, path)
    return sorted(str(st.getPath().toString()) for st in fs.listStatus(folder)) if fs.exists(folder) else []


def delete(spark: SparkSession, paths: list[str]) -> int:
    """Delete these folders with all they hold; returns how many there were."""
    gone = 0
    for path in paths:
        folder, fs = _path(spark, path)
        gone += bool(fs.delete(folder, True))
    return gone
