"""Incremental scoring of arriving files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

Scorer = Callable[[DataFrame], DataFrame]


def committed_batches(spark: SparkSession, checkpoint: str) -> int:
    """How many micro-batches a stream has committed over all its runs: batches count from 0, and the commit log has a file for each.

    Progress reports do not tell: a run without new files reports the number of the batch that would come next.
    """
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/commits")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [status.getPath().getName() for status in files.listStatus(folder)] if files.exists(folder) else []
    return 1 + max((int(name) for name in names if name.isdigit()), default=-1)


def score_stream(
    spark: SparkSession,
    in_dir: str,
    out_dir: str,
    checkpoint: str,
    scorer: Scorer,
    schema: T.StructType,
    file_filter: str = "*.parquet",
    max_files: int | None = None,
) -> int:
    """Scores files not seen before and appends the results; returns the number of micro-batches so far.

    ``scorer`` works row by row, so the stream keeps no state and needs no watermark. The
    checkpoint records finished files: a restarted run continues behind the last finished batch
    instead of rewriting the output.
    """
    source = spark.readStream.schema(schema).option("pathGlobFilter", file_filter)
    if max_files:
        source = source.option("maxFilesPerTrigger", max_files)
    scored = scorer(source.parquet(in_dir))
    query = (
        scored.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return committed_batches(spark, checkpoint)
