"""Importance resampling towards a target distribution, with exact ranks by parallel sorting by regular sampling.

Every feature (a run of one or two words) falls into a hashed bucket. Both corpora are counted by bucket; the logarithm of the ratio
of the two smoothed shares is the bucket's gain, and an array of all gains scores a document in the task that reads it. Gumbel noise
from a hash of the id makes the highest scores a draw without replacement.

The scores are sorted in place, run by run. Rows at regular positions of the sorted runs give the splitters of segments of nearly equal
size; the segments that hold drawn rows are exchanged and sorted, and the counts of all earlier segments turn a row's place in its
segment into its rank. The order is total (score, id, number of the row), so equal scores and repeated ids are split like all others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from codeloom.llm import words as W
from codeloom.settings import materialize

BUCKETS = 10_000
MIN_WORDS = 20
SHARE_PERCENT = 25
SEED = 7
SLICE_BYTES = 1 << 20
#: Every so many rows of a sorted run one is a sample; samples are sampled again until so few are left.
EVERY = 256
MAX_SAMPLES = 65_536
SEGMENT_ROWS = 16_384
MAX_SEGMENTS = 8_192

_VECTOR_BYTES = 32
_CODES = np.arange(256)
_LOWER = np.where((_CODES >= 0x41) & (_CODES <= 0x5A), _CODES + 0x20, _CODES).astype(np.uint8)


def _crc_steps() -> np.ndarray:
    """What one byte does to a CRC-32 register (reversed polynomial 0xEDB88320)."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    return step


_CRC = _crc_steps()
_START = np.uint32(0xFFFFFFFF)


def extend_crc(register: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 registers after the bytes of one span each; a step moves all spans on by one byte, what is left of long ones goes singly."""
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    at, value = starts[order], register[order]
    longer = np.searchsorted(-sizes[order], -np.arange(_VECTOR_BYTES + 1), "left")
    for j in range(_VECTOR_BYTES):
        n = longer[j]
        if not n:
            break
        value[:n] = _CRC[(value[:n] ^ data[at[:n] + j]) & 0xFF] ^ (value[:n] >> 8)
    for i in range(longer[_VECTOR_BYTES]):
        rest = data[at[i] + _VECTOR_BYTES : ends[order[i]]].tobytes()
        value[i] = zlib.crc32(rest, int(value[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(register)
    out[order] = value
    return out


def feature_buckets(piece: W.Slice, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word, bucket of each word with its successor (-1 at the end of a row), and the range of words of each row."""
    data = _LOWER[piece.data]
    starts, ends, bounds = W.find_words(piece, W.ALNUM)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, bounds
    single = extend_crc(np.full(len(starts), _START), data, starts, ends)
    spaced = _CRC[(single ^ np.uint32(0x20)) & 0xFF] ^ (single >> 8)
    pair = extend_crc(spaced[:-1], data, starts[1:], ends[1:])
    inside = np.ones(len(starts), bool)
    last = bounds[1:][bounds[1:] > bounds[:-1]] - 1
    inside[last] = False
    pairs = np.full(len(starts), -1, np.int64)
    pairs[:-1] = (pair ^ _START) % np.uint32(buckets)
    pairs[~inside] = -1
    return ((single ^ _START) % np.uint32(buckets)).astype(np.int64), pairs, bounds


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows: a task adds up its texts, the sums of the tasks are added by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for piece in W.slices(W.text_column(batch, "text"), SLICE_BYTES):
                single, pairs, _ = feature_buckets(piece, buckets)
                total += np.bincount(single, minlength=buckets) + np.bincount(pairs[pairs >= 0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    parts = texts.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket bigint, n bigint")
    out = np.zeros(buckets, np.int64)
    # One row for each bucket at most.
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of target share over source share, with one added to every bucket, rounded down."""
    n = float(len(source))
    ratio = (target + 1.0) * (float(source.sum()) + n) / ((source + 1.0) * (float(target.sum()) + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def gumbel_noise(id_col: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate from the first 32 bits of sha256(``seed:id``), rounded down."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weighted(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, row) of every row; weight is the floored mean gain of the features (none: 0)."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), gumbel_noise(F.col(id_col), seed).alias("noise"),
        F.col(text_col).alias("text"),
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in W.slices(W.text_column(batch, "text"), SLICE_BYTES):
                single, pairs, bounds = feature_buckets(piece, len(gains))
                rows = len(bounds) - 1
                gained = np.concatenate([[0], np.cumsum(gains[single] + np.where(pairs >= 0, gains[pairs], 0))])
                n_words = np.diff(bounds)
                n_features = 2 * n_words - (n_words > 0)
                weight = (gained[bounds[1:]] - gained[bounds[:-1]]) // np.maximum(n_features, 1)
                kept = [batch.column(name).slice(piece.first, rows) for name in ("doc_id", "row", "noise")]
                values = [pa.array(x.astype(np.int64)) for x in (n_words, n_features, weight)]
                yield pa.RecordBatch.from_arrays([*kept, *values], names=["doc_id", "row", "noise", "n_words", "n_features", "weight"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(score, f"doc_id {kind}, row bigint, noise bigint, n_words bigint, n_features bigint, weight bigint")
    return found.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + F.col("noise")).alias("score"), "row")


def _order() -> list[Column]:
    return [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]


def _take_regularly(batches: Iterator[pa.RecordBatch], every: int) -> Iterator[pa.RecordBatch]:
    """The rows at places every-1, 2*every-1, ... of a partition."""
    skip = every - 1
    for batch in batches:
        at = np.arange(skip, batch.num_rows, every)
        yield batch.take(pa.array(at, pa.int64()))
        skip = (skip - batch.num_rows) % every


def choose_splitters(scored: DataFrame, every: int = EVERY, max_samples: int = MAX_SAMPLES, segment_rows: int = SEGMENT_ROWS, max_segments: int = MAX_SEGMENTS) -> list:
    """Keys at which the sorted order is cut into segments of about ``segment_rows`` rows, ``max_segments`` at most.

    Samples of samples are taken until at most ``max_samples`` are left, which is all that the driver gets.
    """
    keys = scored.select("score", "doc_id", "row")
    step = every
    samples = materialize(keys.sortWithinPartitions(*_order()).mapInArrow(partial(_take_regularly, every=every), keys.schema), "samples")
    while (n := samples.count()) > max_samples:
        runs = samples.repartition(max(1, n // (64 * every))).sortWithinPartitions(*_order())
        samples = materialize(runs.mapInArrow(partial(_take_regularly, every=every), keys.schema), "samples")
        step *= every
    points = samples.sort(*_order()).collect()
    apart = max(1, segment_rows // step, -(-len(points) // max_segments))
    return points[apart - 1 :: apart]


def add_segment(scored: DataFrame, splitters: list) -> DataFrame:
    """``scored`` with ``segment``: the number of splitters that are not behind the row."""
    table = scored.sparkSession.createDataFrame([(s.score, s.doc_id, s.row) for s in splitters], scored.select("score", "doc_id", "row").schema).toArrow()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.Table.from_batches([batch]).select(["score", "doc_id", "row"])
            both = pa.concat_tables([table.cast(keys.schema), keys])
            first = pa.array(np.repeat(np.array([0, 1], np.int8), [table.num_rows, keys.num_rows]))
            order = pc.sort_indices(
                both.append_column("later", first),
                sort_keys=[("score", "descending"), ("doc_id", "ascending"), ("row", "ascending"), ("later", "ascending")], null_placement="at_end",
            ).to_numpy()
            before = np.empty(len(order), np.int64)
            before[order] = np.cumsum(order < table.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before[table.num_rows :])], names=[*batch.schema.names, "segment"])

    return scored.mapInArrow(assign, scored.withColumn("segment", F.lit(0).cast("bigint")).schema)


def exact_ranks(scored: DataFrame, wanted: int, **sampling: int) -> DataFrame:
    """``scored`` with ``rank``: 1 to ``wanted`` in order of score (high first), id and row; null behind that.

    ``scored`` has score, doc_id and row (unique) and is read three times, so it should be a written table.
    """
    segmented = add_segment(scored, choose_splitters(scored, **sampling))
    counts = sorted(segmented.groupBy("segment").agg(F.count("*").alias("n")).collect())
    before = np.concatenate([[0], np.cumsum([c.n for c in counts])]).tolist()
    # Segments that begin behind the last wanted rank are neither exchanged nor sorted.
    starts = [(c.segment, b) for c, b in zip(counts, before, strict=False) if b < wanted]
    if not starts:
        return segmented.drop("segment").withColumn("rank", F.lit(None).cast("bigint"))
    offsets = scored.sparkSession.createDataFrame(starts, "segment bigint, earlier bigint")
    last = starts[-1][0]
    place = F.row_number().over(Win.partitionBy("segment").orderBy(*_order()))
    # One row for each segment, of which there are at most MAX_SEGMENTS.
    near = segmented.filter(F.col("segment") <= last).withColumn("place", place).join(F.broadcast(offsets), "segment")
    rank = F.col("earlier") + F.col("place")
    ranked = near.select(*scored.columns, F.when(rank <= wanted, rank).alias("rank"))
    behind = segmented.filter(F.col("segment") > last).select(*scored.columns, F.lit(None).cast("bigint").alias("rank"))
    return ranked.unionByName(behind)


def importance_resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", buckets: int = BUCKETS,
    min_words: int = MIN_WORDS, share_percent: int = SHARE_PERCENT, seed: int = SEED, **sampling: int,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_features, weight, score, rank (null where not drawn).

    Of the rows with at least ``min_words`` words, ``share_percent`` percent (rounded down) are drawn, those with the highest scores; ties
    go to the smaller id, null ids last, and repeated rows are rows of their own. A null or empty text has no features and weight 0; a null
    id draws the noise of an empty one. Without a target all gains come from the smoothing alone. Other columns are not read.
    """
    gains = bucket_gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_text_col, buckets))
    scored = materialize(weighted(docs, gains, id_col, text_col, seed), "weighted")
    long_enough = scored.filter(F.col("n_words") >= min_words)
    ranked = exact_ranks(long_enough, share_percent * long_enough.count() // 100, **sampling)
    short = scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(short).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
