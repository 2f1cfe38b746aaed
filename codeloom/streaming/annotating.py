"""Annotation of arriving files through a ledger of replies."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators import annotation as ann
from ..sources.ledger import Ledger
from .scoring import committed_batches


def annotate_stream(
    spark: SparkSession, in_dir: str, ledger: str, checkpoint: str, client: ann.Client, codebook: DataFrame, schema: T.StructType, text_col: str,
    context_col: str | None = None, prefix: str | None = None, max_labels: int = 6, file_filter: str = "*.parquet", max_files: int = 1, **options: Any,
) -> int:
    """Asks for the rows of files not seen before; returns the number of micro-batches so far.

    A batch is one folder of the ledger. If a run breaks between the folder and the stream's own commit, the batch comes again and finds
    its folder; if it breaks earlier, what other slices hold is not asked again. Results are read with ``annotation.collect_replies``.
    """
    shared = ann.instructions(codebook, max_labels)
    kept = Ledger(spark, ledger, schema["row_id"].dataType.simpleString())
    # A checkpoint numbers its batches anew, so its name is a part of the folder's.
    name = checkpoint.rstrip("/").rpartition("/")[2]

    def annotate_batch(rows: DataFrame, number: int) -> None:
        folder = f"batch-{name}-{number}"
        if not kept.is_committed(folder):
            requests = kept.pending(ann.build_requests(rows, shared, text_col, context_col, prefix).where("filled"), retry_failed=False)
            kept.commit(ann.fan_out(requests, client, shared, **options), folder, 0)

    source = spark.readStream.schema(schema).option("pathGlobFilter", file_filter).option("maxFilesPerTrigger", max_files)
    query = source.parquet(in_dir).writeStream.foreachBatch(annotate_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return committed_batches(spark, checkpoint)
