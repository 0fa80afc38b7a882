"""Session defaults and shipping of this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Settings for a new session; an existing session keeps its own.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Bytes of an Arrow batch on its way to or from Python: rows of long texts would else fill batches of
#: 64 MB, several copies of which a task holds. Set where the session has Spark's default.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m")


def get_session(app: str = "graftline", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers of the session, once per Spark context, and bounds
    the bytes of the batches that they get."""
    key, default, ours = BATCH_BYTES
    if spark.conf.get(key, default) == default:
        spark.conf.set(key, ours)
    sc = spark.sparkContext
    if getattr(sc, "_graftline_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="graftline-"))
    archive = folder / "graftline-package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, os.path.join(package.name, f.relative_to(package)))
    sc.addPyFile(str(archive))
    sc._graftline_shipped = True


def one_machine(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, so that a local folder is seen by all."""
    master = spark.sparkContext.master or ""
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors see: the session's own ``spark.checkpoint.dir``. Only where none is
    set and all runs in one process a local one is made."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not one_machine(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        found = "file://" + tempfile.mkdtemp(prefix="graftline-checkpoints-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Lets ``checkpoint()`` write to the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
