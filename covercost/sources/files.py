"""Files through Spark's own file systems: versions, removal."""

from __future__ import annotations

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of ``path``, and the path as it knows it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def matching(spark: SparkSession, glob: str) -> tuple[tuple[str, int, int], ...]:
    """(path, length, modification time) of every file that a glob matches, and of all files below folders that it matches."""
    fs, at = file_system(spark, glob)
    found: list[tuple[str, int, int]] = []
    for status in fs.globStatus(at) or ():
        if status.isDirectory():
            found += versions(spark, status.getPath().toString())
        else:
            found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return tuple(sorted(found))


def versions(spark: SparkSession, folder: str) -> tuple[tuple[str, int, int], ...]:
    """(path, length, modification time) of every file below ``folder``, on any file system; empty when it isn't there."""
    fs, at = file_system(spark, folder)
    if not fs.exists(at):
        return ()
    found, rest = [], fs.listFiles(at, True)
    while rest.hasNext():
        status = rest.next()
        found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return tuple(sorted(found))


def remove(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.delete(at, True)
