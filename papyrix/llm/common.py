"""Shared plumbing: tables, the shared folder, staged tables, Arrow batch size."""

from __future__ import annotations

import atexit
import ctypes
import ctypes.util
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows in an Arrow batch handed to Python; bounds a worker's memory together with the byte limit.
BATCH_ROWS = 500
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own where that is unset and all
    run in this process; on a cluster an unset one is an error, as a temporary folder would be another on each machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="papyrix-")
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(remove, spark, found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a staged table early; a path that is already gone is no error."""
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    try:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception as e:  # the JVM may be gone when the interpreter ends
        if "Connection" not in type(e).__name__ and "Py4J" not in type(e).__name__:
            raise


def stage(df: DataFrame, name: str, **options) -> tuple[DataFrame, str]:
    """Write a table to the shared folder and read it back: cuts lineage, and a lost executor loses nothing.

    ``options`` are the Parquet writer's. Returns the reread table and its path. It lives until the session's end unless ``remove`` is called.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/papyrix/{name}-{uuid.uuid4().hex}"
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    atexit.register(remove, spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def arrow_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by rows and bytes, so that long texts don't pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_claims: dict = {}


def claim(owner: str, drop) -> None:
    """Say that a worker's task fills ``owner``'s cache from now on: other owners' caches are dropped, so that a worker which
    serves one operator after another holds one cache at a time."""
    for other in [x for x in _claims if x != owner]:
        _claims.pop(other)()
        if ctypes.util.find_library("c"):
            getattr(ctypes.CDLL(ctypes.util.find_library("c")), "malloc_trim", lambda _: 0)(0)
    _claims[owner] = drop
