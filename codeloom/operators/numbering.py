"""Consecutive numbers over a distributed table, without a task that sees all rows and without Python.

``monotonically_increasing_id`` numbers the rows of a partition in its low 33 bits and the partition in the bits above. Written with the
rows, these numbers stay what they are; the counts of all earlier partitions turn them into consecutive ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import materialize

_POSITION = "__position"
_BITS = 33
# The table of partition offsets is sent to all tasks up to this many partitions, and joined by shuffle beyond.
MAX_SENT_PARTITIONS = 1_000_000


def _partition() -> Column:
    return F.shiftright(_POSITION, _BITS)


def _place() -> Column:
    return F.col(_POSITION).bitwiseAND((1 << _BITS) - 1)


def _written(df: DataFrame, order: Sequence[Column] | None) -> tuple[DataFrame, list[tuple[int, int]]]:
    """The table with its positions, and the number of rows of each partition in order."""
    if order is not None:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialize(df.withColumn(_POSITION, F.monotonically_increasing_id()), "positions")
    counts = rows.groupBy(_partition().alias("partition")).agg(F.count("*").alias("n")).collect()
    return rows, sorted((r["partition"], r["n"]) for r in counts)


def consecutive(df: DataFrame, name: str, order: Sequence[Column] | None = None) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... in ``order``, by default in the order of partitions and of rows in them."""
    rows, counts = _written(df, order)
    offsets, total = [], 0
    for partition, n in counts:
        offsets.append((partition, total))
        total += n
    table = df.sparkSession.createDataFrame(offsets, "__partition bigint, __before bigint")
    table = F.broadcast(table) if len(offsets) <= MAX_SENT_PARTITIONS else table
    joined = rows.join(table, _partition() == F.col("__partition"))
    return joined.select(*df.columns, (F.col("__before") + _place()).alias(name))


def first_rows(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """The first ``n`` rows in ``order``: whole partitions of the sorted table, and the head of one."""
    rows, counts = _written(df, order)
    before = 0
    for partition, size in counts:
        if before + size > n:
            kept = (_partition() < partition) | ((_partition() == partition) & (_place() < n - before))
            return rows.where(kept).select(*df.columns)
        before += size
    return rows.select(*df.columns)


def nth_largest(df: DataFrame, value: str, wanted: dict[str, int], group: str, times: str | None = None) -> dict[str, tuple[int, int]]:
    """For each value of ``group`` in ``wanted``: the n-th largest ``value`` (a non-negative BIGINT) and how many rows are above it.

    With ``times`` a row stands for so many.
    Eight bits of the value are settled in each round, by a count of at most 256 rows of a group; nothing is sorted. A group of fewer
    rows than wanted is left out.
    """
    n = (F.sum(times) if times else F.count("*")).alias("n")
    tops = {r[group]: r for r in df.groupBy(group).agg(F.max(value).alias("top"), n).collect() if r[group] in wanted}
    open_groups = {g: 0 for g, r in tops.items() if r["n"] >= wanted[g] > 0}
    above = dict.fromkeys(open_groups, 0)
    widest = max((tops[g]["top"].bit_length() for g in open_groups), default=0)
    for shift in range(-(-max(widest, 1) // 8) * 8 - 8, -1, -8):
        if not open_groups:
            break
        prefix = F.shiftright(value, shift + 8) if shift + 8 < 64 else F.lit(0)
        inside = F.lit(False)
        for g, settled in open_groups.items():
            inside = inside | ((F.col(group) == g) & (prefix == settled))
        digit = F.shiftright(value, shift).bitwiseAND(255).alias("digit")
        counts = df.where(inside).groupBy(group, digit).agg(n).collect()
        for g in open_groups:
            for r in sorted((r for r in counts if r[group] == g), key=lambda r: -r["digit"]):
                if above[g] + r["n"] >= wanted[g]:
                    open_groups[g] = open_groups[g] * 256 + r["digit"]
                    break
                above[g] += r["n"]
    return {g: (settled, above[g]) for g, settled in open_groups.items()}
