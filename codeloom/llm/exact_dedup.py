"""Exact duplicates by skew-safe combining.

Copies are first combined inside each task, then within (digest, salt), where the salt is a residue of the
task number, and last the winners of the salts are combined for each digest. A group that holds a third of
all rows so reaches its last reducer as at most ``salts`` rows. All three steps group by the whole
normalised text as well as by its digest, so the digest only deals out rows and never decides equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.settings import materialize, release_shuffles

SALTS = 64
#: Characters that do not count for equality: [\x20\x09-\x0D]
BLANKS = [" ", "\t", "\n", "\x0b", "\x0c", "\r"]


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest=sha256) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, points.

    Of equal texts the row with the most code points stays, then the smallest id (a null id comes last).
    A null text counts as empty; empty texts are equal to each other. Of rows that repeat id and text exactly
    one is kept. Other columns of ``docs`` are not read. An empty table gives an empty result.
    If ``digest`` ever gives two different texts the same value, the whole text takes its place.
    """
    content = normalised(F.col(text_col))
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.length(F.col(text_col)), F.lit(0)).alias("points"),
        content.alias("content"),
    )
    result = _combine(base, salts, digest)
    return result if result is not None else _combine(base, salts, lambda text: text)


def _combine(base: DataFrame, salts: int, digest) -> DataFrame | None:
    """None if two different texts have the same digest."""
    keyed = base.withColumn("digest", digest(F.col("content")))
    rows = materialize(
        keyed.select(F.monotonically_increasing_id().alias("row"), "doc_id", "points", "digest", sha256(F.col("content")).alias("text_sha256")),
        "dedup-rows",
    )
    rank = F.struct((-F.col("points")).alias("fewer"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"))
    salted = (
        keyed.withColumn("salt", F.spark_partition_id() % salts)
        .groupBy("digest", "salt", "content").agg(F.min(rank).alias("best"), F.count("*").alias("n"))
    )
    winners = materialize(
        salted.groupBy("digest", "content").agg(F.min("best").alias("best"), F.sum("n").alias("group_size"))
        .select("digest", "best", "group_size"),
        "dedup-winners",
    )
    release_shuffles(base.sparkSession)
    if not winners.groupBy("digest").count().filter("count > 1").isEmpty():
        return None
    winners = winners.select("digest", "group_size", F.col("best.id").alias("keep_id"), (-F.col("best.fewer")).alias("most"))
    # Rows that repeat id and text tie as winners; the first of them is the one that stays.
    first = (
        rows.join(winners, "digest").filter((F.col("points") == F.col("most")) & F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .groupBy("digest", "keep_id", "group_size").agg(F.min("row").alias("keep_row"))
    )
    return rows.join(first, "digest").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256", "points"
    )


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns."""
    kept = exact_dedup(docs, id_col, text_col).filter("kept")
    release_shuffles(docs.sparkSession)
    # Generated names keep clear of whatever columns the caller has.
    own = [f"__{n}" for n in ("id", "sha", "points")]
    kept = kept.select(*(F.col(c).alias(name) for c, name in zip(("doc_id", "text_sha256", "points"), own, strict=True)))
    text = F.col(text_col)
    keyed = docs.withColumns({"__sha_own": sha256(normalised(text)), "__points_own": F.coalesce(F.length(text), F.lit(0))})
    joined = keyed.join(
        kept, (keyed["__sha_own"] == kept["__sha"]) & (keyed["__points_own"] == kept["__points"]) & keyed[id_col].eqNullSafe(kept["__id"])
    )
    keys = ["__sha_own", "__points_own", id_col]
    numbered = joined.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*keys)))
    return numbered.filter("__nth = 1").select(*docs.columns)
