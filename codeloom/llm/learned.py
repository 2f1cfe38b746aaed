"""What the two trained scores share: the training rows, and counts of bytes and words of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled documents of each class that a model is fitted on.
SAMPLE_PER_CLASS = 4_000


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, most: int = SAMPLE_PER_CLASS) -> DataFrame:
    """(label, text) of at most ``most`` documents of each class, in the order of the hash of the id.

    Held-out rows, null labels and null ids are left out; an id with labels of both classes counts for both.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).distinct()
    order = [F.xxhash64("id"), F.col("id")]
    chosen = known.filter("label = 0").orderBy(*order).limit(most).union(known.filter("label = 1").orderBy(*order).limit(most))
    # At most twice ``most`` ids: small enough to send to every task.
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "id").select("label", "text")
