"""What is computed once is kept in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a fresh local folder where it is unset and the master is local (tests)."""
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (found.get() if found.isDefined() else None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    if not found.isDefined():
        context.setCheckpointDir(folder)
    return folder


def kept(rows: DataFrame) -> DataFrame:
    """rows, computed once and read from the shared folder from then on."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
