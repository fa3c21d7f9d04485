"""What every job needs from the session: tables, checkpoints, list columns."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``directory``."""
    return spark.read.parquet(os.path.join(directory, f"{name}.parquet"))


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder for reliable checkpoints.

    A cluster names a shared one in ``spark.checkpoint.dir``. Where none is named, only a session whose driver and tasks
    are one machine (``local``) gets a folder of its own; any other raises, since its executors would not see it.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def cut(frame: DataFrame) -> DataFrame:
    """``frame`` written to the checkpoint folder: its lineage ends there and it survives the loss of executors."""
    checkpoint_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def spread(scan: DataFrame) -> DataFrame:
    """A scan dealt out evenly over the cores, if it has fewer partitions than there are cores; a large table has more and
    is left as it is, without any shuffle."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that their Python workers can import it."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "plumbline.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(application)
