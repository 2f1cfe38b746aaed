"""Hard negatives by inner product, with length buckets and sorted coordinate lists (after LEMP).

Vectors are dealt out by length, levels of a tenth, and each level into blocks of bounded size. A query goes to the blocks of a level only
if its length times the level's greatest length can reach the lowest score that it still looks for. In a task a block is cut
into buckets of falling length. With a score to reach, the cosine in a bucket has a lower bound, and that bounds each coordinate of
the unit vectors: on the query's largest coordinates (its focus) a range of the bucket's sorted coordinate list is feasible. Where the
narrowest range is short, the ranges are intersected and only these rows are multiplied; elsewhere the whole bucket is. Found scores raise
the score to reach for the buckets that follow. Every score is an exact integer, so pruning changes no result.

The positives of an anchor are its best rows of the same label; a first search over one block tells each anchor how much it has to
reach in all others. Its negatives are the best rows of other labels inside a band below each positive's score, which gives them a lower
bound from the start. Queries stream through a block in batches, so memory does not grow with their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from codeloom.settings import materialize

BLOCK_ROWS = 8_192
BUCKET_ROWS = 2_048
QUERY_ROWS = 128
#: Levels of length differ by this factor.
LEVEL_RATIO = 1.1
FOCUS = 3
#: Lists are consulted from this cosine on, and used where the narrowest range has less than this share of the bucket.
MIN_COSINE = 0.5
MAX_SHARE = 0.25
#: A level table beyond this many rows is joined by a shuffle instead of being sent to all tasks.
MAX_LEVELS = 100_000
_SLACK = 1e-9
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, label: Column, anchor: Column, scale: int) -> DataFrame:
    """(row, id, label, anchor, y, length, dim, level) of the rows that take part; y is floor(scale * component)."""
    v = F.col(vector_col)
    scaled = F.transform(v, lambda x: F.floor(scale * x.cast("double")).cast("double"))
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), label.alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), v.alias(vector_col)).filter(
        F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.coalesce(whole, F.lit(False))
    )
    rows = rows.select("id", "label", "anchor", scaled.alias("y"), F.monotonically_increasing_id().alias("row"))
    length = F.sqrt(F.aggregate("y", F.lit(0.0), lambda total, x: total + x * x))
    level = F.when(F.col("length") > 0, F.floor(F.log("length") / float(np.log(LEVEL_RATIO)))).otherwise(-1).cast("int")
    return rows.withColumn("length", length).withColumns({"dim": F.size("y"), "level": level})


class Bucket:
    """Rows ``low`` to ``high`` of a block, in order of falling length, with the sorted list of each coordinate that was asked for."""

    def __init__(self, low: int, high: int, y: np.ndarray, lengths: np.ndarray):
        self.low, self.high, self.longest = low, high, float(lengths[low])
        self.y = y[low:high]
        self._unit = self.y / np.maximum(lengths[low:high], 1e-300)[:, None]
        self._lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self._lists:
            order = np.argsort(self._unit[:, f], kind="stable")
            self._lists[f] = order, self._unit[order, f]
        return self._lists[f]

    def feasible(self, unit: np.ndarray, cosine: np.ndarray) -> list[np.ndarray | None]:
        """For each unit query the rows whose focus coordinates allow ``cosine``; None where the lists do not narrow them down."""
        focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
        q = np.take_along_axis(unit, focus, 1)
        t = np.minimum(cosine, 1.0)[:, None]
        spread = np.sqrt(np.maximum(0.0, (1 - t * t) * (1 - np.minimum(1.0, q * q))))
        least = np.where(-q >= t, -1.0, q * t - spread) - _SLACK
        most = np.where(q >= t, 1.0, q * t + spread) + _SLACK
        begin, end = np.empty(focus.shape, np.int64), np.empty(focus.shape, np.int64)
        for f in np.unique(focus):
            values = self.coordinate(int(f))[1]
            at = focus == f
            begin[at], end[at] = np.searchsorted(values, least[at], "left"), np.searchsorted(values, most[at], "right")
        narrow = np.argmin(end - begin, axis=1)
        found: list[np.ndarray | None] = []
        for i, first in enumerate(narrow):
            if end[i, first] - begin[i, first] >= MAX_SHARE * len(self.y):
                found.append(None)
                continue
            rows = self.coordinate(int(focus[i, first]))[0][begin[i, first] : end[i, first]]
            for j, f in enumerate(focus[i]):
                if j != first and len(rows):
                    x = self._unit[rows, f]
                    rows = rows[(x >= least[i, j]) & (x <= most[i, j])]
            found.append(rows)
        return found


class Block:
    """The rows of one block, ready for queries."""

    def __init__(self, table: pa.Table):
        lengths = table.column("length").to_numpy()
        # Equal scores go to the smaller id, so the place in the order of ids stands for the id.
        by_id = pc.sort_indices(table, sort_keys=[("id", "ascending"), ("row", "ascending")]).to_numpy()
        order = by_id[np.argsort(-lengths[by_id], kind="stable")]
        place = np.empty(len(order), np.int64)
        place[by_id] = np.arange(len(by_id))
        self.place = place[order]
        table = table.take(pa.array(order))
        self.ids, self.rows = table.column("id").combine_chunks(), table.column("row").to_numpy()
        self.labels = table.column("label").combine_chunks()
        self.known = pc.unique(self.labels)
        self.codes = pc.index_in(self.labels, self.known).to_numpy()
        self.y = vectors_of(table)
        self.largest = float(np.abs(self.y).max())
        lengths = lengths[order]
        self.buckets = [Bucket(low, min(low + BUCKET_ROWS, len(order)), self.y, lengths) for low in range(0, len(order), BUCKET_ROWS)]


class Probes(NamedTuple):
    """Score bands, several for a query, in order of queries: which query, number of the band, lowest and highest score."""

    query: np.ndarray
    number: np.ndarray
    low: np.ndarray
    high: np.ndarray


def vectors_of(table: pa.Table) -> np.ndarray:
    column = table.column("y").combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1)


def products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products of integer vectors; doubles hold them while no sum can reach 2^53."""
    if bound < 1 << 53:
        return (a @ b).astype(np.int64)
    if bound >= 1 << 63:
        raise ValueError("Inner products of these vectors do not fit into 64 bits.")
    return a.astype(np.int64) @ b.astype(np.int64)


def best_of(probe: np.ndarray, score: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the ``k`` best entries of each probe, in order of probes: high scores first, then low places."""
    order = np.lexsort((place, -score, probe))
    sorted_probe = probe[order]
    first = np.searchsorted(sorted_probe, sorted_probe, "left")
    return order[np.arange(len(order)) - first < k]


def search_block(block: Block, queries: pa.Table, k: int, same_label: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, Probes]:
    """The ``k`` best rows of each probe in the block: number of the probe, row of the block, score."""
    y = vectors_of(queries)
    length, own = queries.column("length").to_numpy(), queries.column("row").to_numpy()
    label = pc.fill_null(pc.index_in(queries.column("label").combine_chunks(), block.known), -1).to_numpy()
    bands = queries.column("bands").combine_chunks()
    per_query = bands.value_lengths().to_numpy()
    number, low, high = (bands.flatten().field(name).to_numpy() for name in ("number", "low", "high"))
    probes = Probes(np.repeat(np.arange(len(y)), per_query), number, low, high)
    starts = np.concatenate([[0], np.cumsum(per_query)])
    unit = y / np.maximum(length, 1e-300)[:, None]
    bound = float(np.abs(y).max(initial=0.0)) * block.largest * y.shape[1]
    floor = low.copy()
    got = (np.zeros(0, np.int64),) * 3
    for bucket in block.buckets:
        least = np.minimum.reduceat(floor, starts[:-1])
        reach = least.astype(float)
        top = length * bucket.longest
        alive = np.flatnonzero(reach <= top * (1 + _SLACK))
        cosine = np.where(reach[alive] > 0, reach[alive] / np.maximum(top[alive], 1e-300), -1.0) * (1 - _SLACK)
        steep = np.flatnonzero(cosine >= MIN_COSINE)
        lists = dict(zip(steep.tolist(), bucket.feasible(unit[alive[steep]], cosine[steep]), strict=True)) if len(steep) else {}
        hits = []
        whole = np.array([alive[i] for i in range(len(alive)) if lists.get(i) is None], np.int64)
        if len(whole):
            score = products(y[whole], bucket.y.T, bound)
            q, r = np.nonzero(score >= least[whole][:, None])
            hits.append((whole[q], r, score[q, r]))
        for i, rows in lists.items():
            if rows is not None and len(rows):
                hits.append((np.full(len(rows), alive[i]), rows, products(bucket.y[rows], y[alive[i]], bound)))
        if not hits:
            continue
        q, r, score = (np.concatenate(x) for x in zip(*hits, strict=True))
        r = r + bucket.low
        fits = ((block.codes[r] == label[q]) == same_label) & (block.rows[r] != own[q])
        q, r, score = q[fits], r[fits], score[fits]
        # Each hit is held against all bands of its query.
        times = per_query[q]
        each = np.repeat(np.arange(len(q)), times)
        probe = starts[q][each] + np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
        inside = (score[each] >= floor[probe]) & (score[each] <= high[probe])
        each, probe = each[inside], probe[inside]
        got = tuple(np.concatenate([a, b]) for a, b in zip(got, (probe, r[each], score[each]), strict=True))
        kept = best_of(got[0], got[2], block.place[got[1]], k)
        got = tuple(a[kept] for a in got)
        full = np.searchsorted(got[0], np.arange(len(low)), "right") - np.searchsorted(got[0], np.arange(len(low)), "left") == k
        floor[full] = np.maximum(floor[full], got[2][np.searchsorted(got[0], np.flatnonzero(full), "right") - 1])
    return (*got, probes)


def _search(batches: Iterator[pa.RecordBatch], k: int, same_label: bool) -> Iterator[pa.RecordBatch]:
    """Rows come before the queries of their block; queries pass through in batches."""

    def runs() -> Iterator[tuple[tuple, pa.Table]]:
        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in ("dim", "level", "part", "query")] if batch.num_rows else []
            change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in keys], axis=0)) + 1 if batch.num_rows else []
            for low, high in zip([0, *change], [*change, batch.num_rows], strict=True):
                if high > low:
                    yield tuple(int(x[low]) for x in keys), pa.Table.from_batches([batch.slice(low, high - low)])

    for _, group in groupby(runs(), key=lambda run: run[0][:3]):
        block, rows = None, []
        for key, table in group:
            if not key[3]:
                rows.append(table)
                continue
            if block is None:
                block, rows = Block(pa.concat_tables(rows)), []
            for low in range(0, table.num_rows, QUERY_ROWS):
                queries = table.slice(low, QUERY_ROWS)
                probe, row, score, probes = search_block(block, queries, k, same_label)
                anchor = queries.column("row").to_numpy()[probes.query[probe]]
                values = [pa.array(anchor), pa.array(probes.number[probe]), block.ids.take(pa.array(row)), pa.array(score)]
                yield pa.RecordBatch.from_arrays(values, names=["row", "band", "id", "score"])


def best_rows(rows: DataFrame, queries: DataFrame, levels: DataFrame, k: int, same_label: bool) -> DataFrame:
    """(row, band, id, score, rank): the ``k`` best rows for each query row and band.

    ``rows`` has a column part; ``queries`` has bands, an array of (number, low, high); ``levels`` has for each (dim, level) the greatest
    length and the range of parts to search.
    """
    lowest = F.array_min(F.transform("bands", lambda b: b.low))
    reachable = queries.join(levels, "dim").filter(lowest <= F.col("length") * F.col("longest") * (1 + _SLACK))
    columns = ["dim", "level", "part", "query", "row", "id", "label", "y", "length", "bands"]
    sent = reachable.select("*", F.explode(F.sequence("from_part", "to_part")).alias("part"), F.lit(1).alias("query")).select(*columns)
    searched = rows.withColumns({"query": F.lit(0), "bands": F.lit(None).cast(queries.schema["bands"].dataType)}).select(*columns)
    block = ["dim", "level", "part"]
    together = searched.unionByName(sent).repartition(*block).sortWithinPartitions(*block, "query")
    kind = rows.schema["id"].dataType.simpleString()
    found = together.mapInArrow(partial(_search, k=k, same_label=same_label), f"row bigint, band bigint, id {kind}, score bigint")
    return first_of(found, k)


def first_of(found: DataFrame, k: int) -> DataFrame:
    order = Win.partitionBy("row", "band").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _bands(low: Column, high: Column, number: Column) -> Column:
    return F.struct(number.cast("bigint").alias("number"), low.cast("bigint").alias("low"), high.cast("bigint").alias("high"))


def _floor_percent(score: Column, percent: int) -> Column:
    return ((percent * score - F.pmod(percent * score, F.lit(100))) / 100).cast("bigint")


def mine(
    vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: str | Column = "label", positives: int = 5,
    negatives: int = 3, low_percent: int = 50, high_percent: int = 95, scale: int = 256, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its first ``positives`` rows of
    the same label the first ``negatives`` rows of other labels with a score of ``low_percent`` to ``high_percent`` percent of the positive's.

    Scores are inner products of floor(``scale`` * component). High scores come first, ties go to the smaller id. Rows with a null id, label or
    vector, an empty vector, or a null or non-finite component take no part; vectors of different dimension are not compared. A repeated row is a
    row of its own: as an anchor it has its own result, and it is a positive of its copy. Anchors without rows of their label or without
    a row in the band give no rows. Scores beyond 64 bits raise an error. Other columns are not read.
    """
    label = F.col(label) if isinstance(label, str) else label
    rows = materialize(integer_vectors(vectors, id_col, vector_col, label, anchor, scale), "vectors")
    sizes = rows.groupBy("dim", "level").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("n_parts"), F.max("length").alias("longest"))
    sizes = materialize(sizes, "levels")
    small = F.broadcast if sizes.count() <= MAX_LEVELS else lambda df: df
    dealt = rows.join(small(sizes), ["dim", "level"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("n_parts")).cast("int")).drop("n_parts", "longest")
    first = sizes.groupBy("dim").agg(F.max("longest").alias("most")).join(small(sizes), "dim").filter("longest = most").select("dim", F.col("level").alias("first_level"))
    is_first = F.col("level") == F.col("first_level")
    levels = sizes.join(small(first), "dim").select("dim", "level", "longest", is_first.alias("first"), F.lit(0).alias("from_part"), (F.col("n_parts") - 1).alias("to_part"))
    dealt = dealt.join(small(first), "dim").withColumn("seed", is_first & (F.col("part") == 0)).drop("first_level")
    anchors = rows.filter("anchor").select("row", "id", "label", "y", "length", "dim")

    # One block of the longest vectors tells each anchor what it has to reach in the others.
    unbounded = anchors.withColumn("bands", F.array(_bands(F.lit(_LEAST), F.lit(_MOST), F.lit(0))))
    seed_levels = levels.filter("first").withColumn("to_part", F.lit(0))
    seeds = materialize(best_rows(dealt.filter("seed"), unbounded, small(seed_levels), positives, True).drop("rank"), "seeds")
    reached = first_of(seeds, positives).filter(F.col("rank") == positives).select("row", F.col("score").alias("reached"))
    bounded = anchors.join(reached, "row", "left").withColumn("bands", F.array(_bands(F.coalesce("reached", F.lit(_LEAST)), F.lit(_MOST), F.lit(0)))).drop("reached")
    other_levels = levels.withColumn("from_part", F.when(F.col("first"), 1).otherwise(0)).filter("from_part <= to_part")
    others = best_rows(dealt.filter("NOT seed"), bounded, small(other_levels), positives, True).drop("rank")
    best = first_of(seeds.unionByName(others), positives).select("row", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    best = materialize(best, "positives")

    score = F.col("positive_score")
    wanted = best.select("row", _bands(-_floor_percent(-score, low_percent), _floor_percent(score, high_percent), score).alias("b")).filter("b.low <= b.high")
    near = best_rows(dealt, anchors.join(wanted.groupBy("row").agg(F.sort_array(F.collect_set("b")).alias("bands")), "row"), small(levels), negatives, False)
    near = near.select("row", F.col("band").alias("positive_score"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = anchors.select("row", F.col("id").alias("anchor_id"))
    return best.join(near, ["row", "positive_score"]).join(named, "row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
