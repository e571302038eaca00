"""Files of any Hadoop file system, seen from the driver: listing, existence, renaming."""

from __future__ import annotations

from pyspark.sql import SparkSession


def hadoop(spark: SparkSession, name: str) -> tuple:
    """A Hadoop path and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, name: str) -> bool:
    path, files = hadoop(spark, name)
    return files.exists(path)


def is_folder(spark: SparkSession, name: str) -> bool:
    path, files = hadoop(spark, name)
    return files.exists(path) and files.getFileStatus(path).isDirectory()


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files in a folder, not those below it, sorted."""
    path, files = hadoop(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(path) if s.isFile())


def sizes(spark: SparkSession, folder: str) -> dict[str, int]:
    path, files = hadoop(spark, folder)
    return {s.getPath().getName(): s.getLen() for s in files.listStatus(path) if s.isFile()}


def remove(spark: SparkSession, name: str) -> None:
    path, files = hadoop(spark, name)
    files.delete(path, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file or folder; an existing target is an error."""
    path, files = hadoop(spark, source)
    to, _ = hadoop(spark, target)
    if files.exists(to):
        raise ValueError(f"{target} exists")
    if to.getParent() is not None:
        files.mkdirs(to.getParent())
    if not files.rename(path, to):
        raise OSError(f"{source} could not be renamed to {target}")
