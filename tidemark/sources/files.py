"""Files and folders of whatever store Spark reads, through Hadoop's file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def entries(spark: SparkSession, path: str) -> list[dict]:
    """name, path, folder and size of what lies in a folder, by name; FileNotFoundError if it isn't there."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    out = [{"name": e.getPath().getName(), "path": e.getPath().toString(), "folder": e.isDirectory(), "size": int(e.getLen())} for e in fs.listStatus(p)]
    return sorted(out, key=lambda e: e["name"])


def make_folder(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.mkdirs(p)


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a file, or a folder with all that is in it; False if there was none."""
    fs, p = _at(spark, path)
    return fs.delete(p, True)


def copy(spark: SparkSession, source: str, target: str) -> None:
    a, p = _at(spark, source)
    b, q = _at(spark, target)
    if not spark._jvm.org.apache.hadoop.fs.FileUtil.copy(a, p, b, q, False, True, spark._jsc.hadoopConfiguration()):
        raise OSError(f"{source} was not copied to {target}")
