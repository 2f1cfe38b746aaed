"""Deterministic random order by hash, with exact ranks and exact quotas per group.

Every random choice of the library orders rows by ``md5(seed|key…)``. Because the order is a
hash, its leading hex digits cut each group into buckets of nearly equal size that are already
in order, so a rank is ``rows in earlier buckets + rank inside the bucket``. A group that holds
a third of all rows is thereby spread over thousands of tasks instead of one window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.binding import bind

BUCKET_DIGITS = 3
#: Rows that a bucket should have at most.
BUCKET_ROWS = 50_000


def digits_for(n_rows: int) -> int:
    """Leading hex digits that cut ``n_rows`` rows into buckets of at most about ``BUCKET_ROWS``, 3 at least."""
    digits = BUCKET_DIGITS
    while n_rows > BUCKET_ROWS * 16**digits:
        digits += 1
    return digits


def hash_order(seed: int | Column, *keys: Column) -> Column:
    head = seed if isinstance(seed, Column) else F.lit(seed)
    return F.md5(F.concat_ws("|", head.cast("string"), *[k.cast("string") for k in keys]))


def hash_number(seed: int, *keys: Column) -> Column:
    """32 random bits as BIGINT."""
    return F.conv(F.substring(hash_order(seed, *keys), 1, 8), 16, 10).cast("bigint")


def _bucket(order_col: str, digits: int) -> Column:
    return F.substring(F.col(order_col), 1, digits)


def _bucket_counts(df: DataFrame, groups: Sequence[str], order_col: str, digits: int) -> DataFrame:
    """Rows per (group, bucket) and in all earlier buckets: at most ``16**digits`` rows per group."""
    counts = df.groupBy(*groups, _bucket(order_col, digits).alias("_bucket")).agg(F.count("*").alias("_in_bucket"))
    earlier = W.partitionBy(*groups).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_in_bucket").over(earlier), F.lit(0)))


def hash_rank(
    df: DataFrame, groups: Sequence[str], order_col: str, rank_col: str = "rank", digits: int = BUCKET_DIGITS
) -> DataFrame:
    """0-based contiguous rank of every row inside its group, ordered by the hash ``order_col``.

    The join and the window below share one shuffle on (groups, bucket).
    """
    keys = [*groups, "_bucket"]
    offsets = _bucket_counts(df, groups, order_col, digits)
    inside = W.partitionBy(*keys).orderBy(order_col)
    return (
        df.withColumn("_bucket", _bucket(order_col, digits))
        .join(offsets.select(*keys, "_before"), keys)
        .withColumn(rank_col, F.col("_before") + F.row_number().over(inside) - 1)
        .drop("_bucket", "_before")
    )


def hash_cutoffs(
    df: DataFrame, groups: Sequence[str], order_col: str, quotas: DataFrame, digits: int = BUCKET_DIGITS
) -> DataFrame:
    """The hash up to which rows of a group are inside its quota.

    ``quotas`` has ``groups`` and one column ``quota_<name>`` for each wanted cutoff; the result
    has ``groups`` and ``cut_<name>`` (null where the quota is 0). Only the one bucket in which a
    quota ends is sorted; all other rows are counted and never moved.
    """
    names = [c.removeprefix("quota_") for c in quotas.columns if c.startswith("quota_")]
    limits = quotas.select(
        *groups,
        F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"quota_{n}").alias("quota")) for n in names])).alias("q"),
    ).select(*groups, "q.name", "q.quota")
    counts = _bucket_counts(df, groups, order_col, digits)
    edge = (
        counts.join(limits, list(groups))
        .where((F.col("_before") < F.col("quota")) & (F.col("quota") <= F.col("_before") + F.col("_in_bucket")))
        .select(*groups, "_bucket", "name", (F.col("quota") - F.col("_before")).alias("_wanted"))
    )
    keys = [*groups, "_bucket", "name"]
    cut = (
        df.select(*groups, order_col, _bucket(order_col, digits).alias("_bucket"))
        .join(edge, [*groups, "_bucket"])
        .withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(order_col)))
        .where(F.col("_rn") == F.col("_wanted"))
        .groupBy(*groups)
        .agg(*[F.max(F.when(F.col("name") == n, F.col(order_col))).alias(f"cut_{n}") for n in names])
    )
    return quotas.select(*groups).join(cut, list(groups), "left")


def stratified_draw(total: Column, wanted: Column, seed: int, *keys: Column) -> Column:
    """``wanted`` distinct numbers of ``[0, total)`` as an array, all of them if there are no more.

    The range is cut into ``wanted`` intervals and one number is taken by hash from each, so the
    numbers are distinct by construction and no rejection loop is needed.
    """

    def draw(span: Column) -> Column:
        total, n = span["total"], span["n"]
        step, rest = F.floor(total / n), total % n

        def pick(t: Column) -> Column:
            start = t * step + F.least(t, rest)
            width = step + F.when(t < rest, 1).otherwise(0)
            return start + hash_number(seed, *keys, t) % width

        return F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), pick)

    span = F.struct(total.cast("bigint").alias("total"), F.least(total, wanted).cast("bigint").alias("n"))
    return F.when((total > 0) & (wanted > 0), bind(span, draw)).otherwise(F.array().cast("array<bigint>"))
