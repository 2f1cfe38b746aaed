"""Exact nearest neighbours by cosine within groups, with pivots that tell which blocks cannot hold any.

The candidates of a group (all rows with the same keys) are dealt out to the nearest of a few pivots, which are candidates themselves. A pivot
knows the angle of its farthest candidate, its radius. By the triangle inequality no candidate of a pivot is closer to a query than the
angle to the pivot less the radius. Every query first searches the candidates of its own pivot, which gives it ``k`` neighbours; it goes on to
those pivots only that may hold better ones. The result does not depend on the choice of pivots.

The candidates of a pivot lie in blocks of bounded size. Each block is sent to one task, once; the queries that visit it stream through
that task in batches. Only queries are copied, once for each block they visit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial
from itertools import groupby
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..settings import MAX_BROADCAST_BYTES, materialize

BLOCK_ROWS = 4096
QUERY_ROWS = 256
#: Most pivots of a group.
MAX_PIVOTS = 32
# Scores are rounded below the noise of a matrix product, so that equal vectors tie exactly; bounds keep well away from that.
DIGITS = 12
_SLACK = 1e-9


def unit_rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one dimension as rows of unit length; a zero vector stays zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    matrix = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


class Pivots(NamedTuple):
    """For each group (a tuple of keys) the numbers of its pivots and their unit vectors."""

    keys: list[str]
    of: dict[tuple, np.ndarray]


class Reach(NamedTuple):
    """For each group and pivot the number of blocks and the radius."""

    parts: dict[tuple, np.ndarray]
    radius: dict[tuple, np.ndarray]


def choose_pivots(candidates: DataFrame, keys: list[str], block_rows: int, max_pivots: int) -> Pivots:
    """One pivot for ``block_rows`` candidates of a group, drawn by hash; none where all of them would not fit into the broadcast bound."""
    shape = candidates.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d"))
    sized = materialize(shape.withColumn("wanted", F.least(F.ceil(F.col("n") / block_rows), F.lit(max_pivots))), "group-sizes")
    total = sized.agg(F.coalesce(F.sum(F.col("wanted") * F.col("d") * 8), F.lit(0))).first()[0]
    if total > MAX_BROADCAST_BYTES:
        return Pivots(keys, {})
    order = W.partitionBy(*keys).orderBy(F.xxhash64("cand_id"), "cand_id")
    drawn = candidates.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max_pivots)
    drawn = drawn.join(sized.select(*keys, "wanted"), keys).where(F.col("_n") <= F.col("wanted")).select(*keys, "_n", "vector").toArrow()
    of: dict[tuple, list] = {}
    for row, vector in zip(drawn.select(keys).to_pylist(), drawn.column("vector"), strict=True):
        of.setdefault(tuple(row[key] for key in keys), []).append(np.asarray(vector.as_py(), np.float64))
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    return Pivots(keys, {key: unit(np.array(rows)) for key, rows in of.items()})


def _by_group(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """Groups of a batch and the places of their rows."""
    places: dict[tuple, list[int]] = {}
    for n, row in enumerate(zip(*(batch.column(key).to_pylist() for key in keys), strict=True)):
        places.setdefault(row, []).append(n)
    for key, at in places.items():
        yield key, np.array(at)


def _assign(batches: Iterator[pa.RecordBatch], pivots: Broadcast[Pivots]) -> Iterator[pa.RecordBatch]:
    """The nearest pivot of each candidate and the angle to it. Without pivots, and for a zero vector, the angle is that of no bound."""
    for batch in batches:
        pivot, angle = np.zeros(batch.num_rows, np.int32), np.full(batch.num_rows, np.pi)
        for key, at in _by_group(batch, pivots.value.keys):
            own = pivots.value.of.get(key)
            if own is not None:
                unit = unit_rows(batch.column("vector").take(pa.array(at)))
                cosine = unit @ own.T
                pivot[at] = cosine.argmax(axis=1)
                angle[at] = np.where(unit.any(axis=1), _angle(cosine.max(axis=1)), np.pi)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(angle)], names=[*batch.schema.names, "pivot", "angle"])


def _visits(batches: Iterator[pa.RecordBatch], pivots: Broadcast[Pivots], reach: Broadcast[Reach], home: bool) -> Iterator[pa.RecordBatch]:
    """The blocks (pivot, part) that a query visits: those of its own pivot, or else all others that may hold a better candidate than ``reached``."""
    for batch in batches:
        blocks: list[list[dict[str, int]]] = [[] for _ in range(batch.num_rows)]
        reached = None if home else pc.fill_null(batch.column("reached"), -2.0).to_numpy()
        for key, at in _by_group(batch, pivots.value.keys):
            parts = reach.value.parts.get(key)
            if parts is None:
                continue
            unit = unit_rows(batch.column("vector").take(pa.array(at)))
            own = pivots.value.of.get(key)
            cosine = unit @ own.T if own is not None else np.zeros((len(at), len(parts)))
            nearest = np.where(parts > 0, cosine, -2.0).argmax(axis=1)
            if home:
                wanted = np.arange(len(parts)) == nearest[:, None]
            else:
                best = np.cos(np.maximum(_angle(cosine) - reach.value.radius[key], 0.0))
                # A zero vector has no angle; the bound of any block is then that of the cosine 0.
                best[~unit.any(axis=1)] = 1.0
                wanted = (best >= reached[at][:, None] - _SLACK) & (parts > 0)
                wanted[np.arange(len(at)), nearest] = False
            for n, flags in zip(at.tolist(), wanted, strict=True):
                blocks[n] = [{"pivot": int(p), "part": part} for p in np.flatnonzero(flags) for part in range(int(parts[p]))]
        kind = pa.list_(pa.struct([("pivot", pa.int32()), ("part", pa.int32())]))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks, kind)], names=[*batch.schema.names, "blocks"])


def _best_in_block(names: pa.Array, unit: np.ndarray, queries: pa.Table, keys: list[str], k: int) -> pa.RecordBatch:
    """The ``k`` best candidates of each query; ``names`` are in ascending order."""
    scores = np.round(unit_rows(queries.column("vector")) @ unit.T, DIGITS)
    least = -np.partition(-scores, k - 1, axis=1)[:, k - 1] if scores.shape[1] > k else np.full(len(scores), -np.inf)
    row, column = np.nonzero(scores >= least[:, None])
    value = scores[row, column]
    order = np.lexsort((column, -value, row))
    row, column, value = row[order], column[order], value[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    at = pa.array(row[kept])
    columns = [queries.column(c).combine_chunks().take(at) for c in [*keys, "row_id"]]
    return pa.RecordBatch.from_arrays([*columns, names.take(pa.array(column[kept])), pa.array(value[kept])], names=[*keys, "row_id", "cand_id", "score"])


def _search(batches: Iterator[pa.RecordBatch], keys: list[str], k: int) -> Iterator[pa.RecordBatch]:
    """The candidates of a block come before its queries, which pass through in batches."""
    place = [*keys, "pivot", "part"]

    def runs() -> Iterator[tuple[tuple, bool, pa.Table]]:
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in [*place, "is_query"]), strict=True))
            low = 0
            for key, same in groupby(rows):
                high = low + sum(1 for _ in same)
                yield key[:-1], bool(key[-1]), pa.Table.from_batches([batch.slice(low, high - low)])
                low = high

    for _, group in groupby(runs(), key=lambda run: run[0]):
        waiting: list[pa.Table] = []
        names: Any = None
        for _, is_query, table in group:
            if not is_query:
                waiting.append(table)
                continue
            if names is None and not waiting:
                continue
            if names is None:
                block = pa.concat_tables(waiting).sort_by("cand_id")
                names, unit, waiting = block.column("cand_id").combine_chunks(), unit_rows(block.column("vector")), []
            for low in range(0, table.num_rows, QUERY_ROWS):
                yield _best_in_block(names, unit, table.slice(low, QUERY_ROWS), keys, k)


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = W.partitionBy(*keys, "row_id").orderBy(F.desc("score"), "cand_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class BlockSearch:
    """Candidates in blocks, ready for several searches. ``candidates`` has keys, ``cand_id, vector``."""

    def __init__(self, candidates: DataFrame, keys: Sequence[str], block_rows: int = BLOCK_ROWS, max_pivots: int = MAX_PIVOTS):
        spark, self.keys = candidates.sparkSession, list(keys)
        rows = candidates.select(*self.keys, "cand_id", F.col("vector").cast("array<double>").alias("vector")).where("vector IS NOT NULL")
        self.pivots = spark.sparkContext.broadcast(choose_pivots(rows, self.keys, block_rows, max_pivots))
        types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        assigned = materialize(rows.mapInArrow(partial(_assign, pivots=self.pivots), f"{types}, pivot int, angle double"), "assigned")
        sizes = assigned.groupBy(*self.keys, "pivot").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts"), F.max("angle").alias("radius"))
        sizes = materialize(sizes, "pivot-sizes")
        # As many rows as there are pivots, which are within the bound, or one for each group.
        parts, radius = {}, {}
        for r in sizes.collect():
            key = tuple(r[c] for c in self.keys)
            n = max(len(self.pivots.value.of.get(key, [0])), 1)
            parts.setdefault(key, np.zeros(n, np.int64))[r["pivot"]] = r["parts"]
            radius.setdefault(key, np.zeros(n))[r["pivot"]] = r["radius"]
        self.reach = spark.sparkContext.broadcast(Reach(parts, radius))
        dealt = assigned.join(F.broadcast(sizes.drop("radius")), [*self.keys, "pivot"])
        self.dealt = dealt.select(*self.keys, "pivot", F.pmod(F.xxhash64("cand_id"), F.col("parts")).cast("int").alias("part"), "cand_id", "vector")

    def visits(self, queries: DataFrame, home: bool) -> DataFrame:
        """One row for each block that a query visits. ``queries`` has keys, ``row_id, vector`` and, unless ``home``, ``reached``."""
        types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema.fields)
        run = partial(_visits, pivots=self.pivots, reach=self.reach, home=home)
        planned = queries.mapInArrow(run, f"{types}, blocks array<struct<pivot:int,part:int>>")
        return planned.select(*self.keys, "row_id", "vector", F.explode("blocks").alias("b")).select(*self.keys, "row_id", "vector", "b.pivot", "b.part")

    def _visit(self, visits: DataFrame, k: int) -> DataFrame:
        row_type, cand_type = visits.schema["row_id"].dataType, self.dealt.schema["cand_id"].dataType
        place = [*self.keys, "pivot", "part"]
        columns = [*place, "is_query", "row_id", "cand_id", "vector"]
        blocks = self.dealt.withColumns({"is_query": F.lit(False), "row_id": F.lit(None).cast(row_type)})
        sent = visits.withColumns({"is_query": F.lit(True), "cand_id": F.lit(None).cast(cand_type)})
        together = blocks.select(*columns).unionByName(sent.select(*columns)).repartition(*place).sortWithinPartitions(*place, "is_query")
        types = ", ".join(f"`{c}` {visits.schema[c].dataType.simpleString()}" for c in [*self.keys, "row_id"])
        return together.mapInArrow(partial(_search, keys=self.keys, k=k), f"{types}, cand_id {cand_type.simpleString()}, score double")

    def top_k(self, queries: DataFrame, k: int) -> DataFrame:
        """``(keys, row_id, cand_id, score, rank)``: the ``k`` most similar candidates of each query in its group; ties by ``cand_id``.

        ``queries`` has keys, ``row_id, vector``; a row occurs once with the same keys.
        """
        asked = queries.select(*self.keys, "row_id", F.col("vector").cast("array<double>").alias("vector")).where("vector IS NOT NULL")
        near = materialize(_first(self._visit(self.visits(asked, True), k), self.keys, k), "own-pivot")
        reached = near.where(F.col("rank") == k).select(*self.keys, "row_id", F.col("score").alias("reached"))
        others = self._visit(self.visits(asked.join(reached, [*self.keys, "row_id"], "left"), False), k)
        return _first(near.drop("rank").unionByName(others), self.keys, k)
