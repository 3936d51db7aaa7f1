"""The shared folder that iterative operators checkpoint to."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> None:
    """Set the context's checkpoint folder to the shared one."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder(spark))


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset and all run in this process, a temporary one, on a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="papyrix-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{folder(spark)}/papyrix/{name}-{uuid.uuid4().hex}"
