"""Small files through the cluster's file system: listing, reading and writing on the driver."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import SparkSession

from ..session import shared_dir


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none where there is no such folder."""
    fs, where = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def split_path(path: str) -> tuple[str, str]:
    """(folder, name); a bare name lies in the working folder."""
    folder, slash, name = path.rstrip("/").rpartition("/")
    return (folder or ("/" if slash else "."), name)


def read_text(spark: SparkSession, path: str) -> str:
    """A whole small text."""
    fs, where = _at(spark, path)
    source = fs.open(where)
    try:
        return bytes(source.readAllBytes()).decode("utf-8")
    finally:
        source.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, where = _at(spark, path)
    sink = fs.create(where, True)
    try:
        sink.write(bytearray(text.encode("utf-8")))
    finally:
        sink.close()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/graftline/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        try:
            fs, where = _at(spark, path)
            fs.delete(where, True)
        except Exception:  # the JVM may be gone already
            pass
