"""Names and limits shared by all modules."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

UNKNOWN = "UNKNOWN"

# A table may be brought to the driver (to become a literal or a broadcast variable)
# only after a count has shown that it is below these bounds.
MAX_LITERAL_CODES = 5_000
MAX_BROADCAST_BYTES = 256 * 1024 * 1024

_OPEN_SCOPES: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can read and write.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset, a master of one machine
    (``local[...]``) takes a fresh temporary folder, remembered in the session; any other master is
    refused, because its executors would each write to a disk of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("codeloom.scratch.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a shared folder when the master is {master}.")
        folder = tempfile.mkdtemp(prefix="codeloom-")
        spark.conf.set("codeloom.scratch.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    path = os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")
    if _OPEN_SCOPES:
        _OPEN_SCOPES[-1].append(path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder written by ``materialize``, on whatever file system it lies."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Removes the intermediate tables made inside the block when it ends.

    Results that are still lazy read those tables, so they must be written inside the block.
    """
    paths: list[str] = []
    _OPEN_SCOPES.append(paths)
    try:
        yield
    finally:
        _OPEN_SCOPES.remove(paths)
        for path in paths:
            remove_path(spark, path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the files.

    Cuts the lineage in a way that survives the loss of executors.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs.

    Spark deletes them when the driver's garbage collector meets their handles, which may be long after a job with many steps
    has filled the disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def collect_bounded(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a dimension-sized table; refuses to pull more than ``limit`` rows."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows and cannot become a literal.")
    return rows
