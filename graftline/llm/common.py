"""Helpers that the operators share: table access, the shared folder, cut lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import one_machine

#: ASCII white space that separates words in the operators' word rule ``[^\x20\x09-\x0D]+``.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir`` of the session.

    Only where it is unset and all runs in one process (tests) a local folder is made and set.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not one_machine(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        found = "file://" + os.path.join(tempfile.gettempdir(), "graftline-shared")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/graftline/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove_quietly, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        try:
            remove(spark, path)
        except Exception:  # the JVM may be gone already
            pass


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes a table to the shared folder and rereads it: what follows survives lost executors
    without running the plan behind it again."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
