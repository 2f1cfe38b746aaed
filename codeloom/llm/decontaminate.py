"""Benchmark decontamination by winnowing.

Every window of ``w`` consecutive k-gram hashes keeps its minimum, on both sides. A span of ``w + k - 1`` words
that documents and benchmark share contains the same window, so both sides keep the same k-gram from it: no
shared span of that length is missed. Equal fingerprints are then extended word by word in both directions.
With windows of 13 words the defaults k = 7 and w = 7 cover exactly this length.

The fingerprints of the benchmark are joined to those of the documents inside the scan of the documents, as a
broadcast of blocks of at most ``block_bytes`` of benchmark text; more benchmark means more blocks, each joined to
all documents. Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import words as W

WINDOW = 13
K = 7
BLOCK_BYTES = 8 << 20
MIN_SHARE = 20


class Index(NamedTuple):
    """One block of the benchmark: word hashes of all items, and fingerprints of full and of short windows."""

    hashes: np.ndarray
    texts: list[bytes]
    bounds: np.ndarray
    ids: list
    prints: np.ndarray
    places: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]


def row_prints(hashes: np.ndarray, bounds: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all rows of a slice and their word positions.

    Windows are taken over the whole slice; those that lie in two rows are dropped.
    """
    grams = W.run_hashes(hashes, k)
    n = len(grams) - w + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    row_of = np.searchsorted(bounds, np.arange(n), "right")
    inside = np.arange(n) + (w + k - 1) <= bounds[np.minimum(row_of, len(bounds) - 1)]
    low, at = grams[:n].copy(), np.arange(n)
    for j in range(1, w):
        lower = grams[j : j + n] <= low
        low = np.where(lower, grams[j : j + n], low)
        at = np.where(lower, np.arange(j, j + n), at)
    at = np.unique(at[inside])
    return grams[at], at


def _find(prints: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) with sought[i] == prints[j]; ``prints`` is sorted."""
    low, high = np.searchsorted(prints, sought, "left"), np.searchsorted(prints, sought, "right")
    count = high - low
    i = np.repeat(np.arange(len(sought)), count)
    j = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    return i, j


def build_index(ids: list, texts: list[str | None], window: int = WINDOW, k: int = K) -> Index:
    column = pa.array([t or "" for t in texts], pa.large_string())
    hashes, spans, bounds, kept = [], [], [0], []
    for piece in W.slices(column):
        found = W.words(piece, W.ALNUM)
        for r in range(len(piece.bounds) - 1):
            low, high = found.bounds[r], found.bounds[r + 1]
            if high > low:
                hashes.append(found.hashes[low:high])
                spans += [piece.data[s:e].tobytes().lower() for s, e in zip(found.starts[low:high], found.ends[low:high], strict=True)]
                bounds.append(bounds[-1] + int(high - low))
                kept.append(ids[piece.first + r])
    flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    ends = np.array(bounds, np.int64)
    prints, places = row_prints(flat, ends, k, window - k + 1)
    order = np.argsort(prints, kind="stable")
    short: dict[int, tuple[list, list]] = {}
    for n in range(len(kept)):
        size = bounds[n + 1] - bounds[n]
        if size < window:
            whole, at = short.setdefault(size, ([], []))
            whole.append(W.sequence_hash(flat[bounds[n] : bounds[n + 1]]))
            at.append(bounds[n])
    sorted_short = {}
    for size, (whole, at) in short.items():
        values, where = np.array(whole, np.uint64), np.array(at, np.int64)
        by = np.argsort(values, kind="stable")
        sorted_short[size] = values[by], where[by]
    return Index(flat, spans, ends, kept, prints[order], places[order], sorted_short)


def _same_words(index: Index, piece: W.Slice, found: W.Words, at: int, place: int, size: int) -> bool:
    """The exact check behind the hashes."""
    data = piece.data
    return all(
        data[found.starts[at + n] : found.ends[at + n]].tobytes().lower() == index.texts[place + n] for n in range(size)
    )


def match(index: Index, piece: W.Slice, found: W.Words, window: int = WINDOW, k: int = K) -> Iterator[tuple[int, int, int, int]]:
    """Maximal shared spans of at least a window: (first word, end word, item number, row), words counted over the slice."""
    hashes, bounds = found.hashes, found.bounds
    prints, at = row_prints(hashes, bounds, k, window - k + 1)
    i, j = _find(index.prints, prints)
    done: dict[int, int] = {}
    for position, place in sorted(zip(at[i].tolist(), index.places[j].tolist(), strict=True)):
        # Hits of one shared span lie on one diagonal; the first of them yields the whole span.
        if done.get(position - place, -1) > position:
            continue
        row = int(np.searchsorted(bounds, position, "right")) - 1
        item = int(np.searchsorted(index.bounds, place, "right")) - 1
        low, high = position, position
        back = min(position - bounds[row], place - index.bounds[item])
        while back > 0 and hashes[low - 1] == index.hashes[place - (position - low) - 1]:
            low, back = low - 1, back - 1
        ahead = min(bounds[row + 1] - position, index.bounds[item + 1] - place)
        while ahead > 0 and hashes[high] == index.hashes[place + (high - position)]:
            high, ahead = high + 1, ahead - 1
        if high - low >= window and _same_words(index, piece, found, low, place - (position - low), high - low):
            done[position - place] = high
            yield low, high, item, row
    for size, (whole, places) in index.short.items():
        grams = W.run_hashes(hashes, size)
        i, j = _find(whole, grams)
        for position, place in zip(i.tolist(), places[j].tolist(), strict=True):
            row = int(np.searchsorted(bounds, position, "right")) - 1
            if position + size <= bounds[row + 1] and _same_words(index, piece, found, position, place, size):
                yield position, position + size, int(np.searchsorted(index.bounds, place, "right")) - 1, row


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], high)
        else:
            out.append((low, high))
    return out


_SPANS = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))


def _scan(index: Index, text_col: str, window: int, k: int):
    """Adds the spans and items of one block to those found before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words = np.zeros(batch.num_rows, np.int64)
            spans = [[(s["low"], s["high"]) for s in row] for row in batch.column("__spans").to_pylist()]
            items = batch.column("__items").to_pylist()
            for piece in W.slices(W.text_column(batch, text_col)):
                found = W.words(piece, W.ALNUM)
                n_words[piece.first : piece.first + len(found.bounds) - 1] = np.diff(found.bounds)
                for low, high, item, row in match(index, piece, found, window, k):
                    base = found.bounds[row]
                    spans[piece.first + row].append((int(low - base), int(high - base)))
                    items[piece.first + row].append(index.ids[item])
            columns = {name: batch.column(name) for name in batch.schema.names}
            columns["__n_words"] = pa.array(n_words)
            columns["__spans"] = pa.array([[{"low": a, "high": b} for a, b in _merge(row)] for row in spans], _SPANS)
            columns["__items"] = pa.array([sorted({i for i in row if i is not None}) for row in items], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def shared_spans(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, k: int = K, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with ``__n_words``, ``__spans`` (merged word ranges that occur in items) and ``__items`` (ids as sorted strings).

    Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters. A window is ``window`` consecutive
    item words, or the whole of a shorter item. Null texts have no words; items without words match nothing; an item
    with a null id marks words but is not listed. Items that repeat an id count once.
    """
    if not 1 <= k <= window:
        raise ValueError("k must lie between 1 and the window.")
    items = benchmark.select(F.col(item_id_col).cast("string").alias("id"), F.col(item_text_col).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    block_of = F.pmod(F.xxhash64("id", "text"), F.lit(blocks))
    out = docs.withColumns({
        "__n_words": F.lit(0).cast("bigint"),
        "__spans": F.array().cast("array<struct<low:int,high:int>>"),
        "__items": F.array().cast("array<string>"),
    })
    for block in range(blocks):
        rows = items.filter(block_of == block).collect()
        out = out.mapInArrow(_scan(build_index([r.id for r in rows], [r.text for r in rows], window, k), text_col, window, k), out.schema)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans."""
    found = shared_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, **options)
    hit = F.aggregate("__spans", F.lit(0).cast("bigint"), lambda total, s: total + (s["high"] - s["low"]))
    return found.select("doc_id", F.col("__n_words").alias("n_words"), hit.alias("n_hit"), F.col("__spans").alias("spans"), F.col("__items").alias("items")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"), "spans",
    )


def is_contaminated(n_hit, n_words):
    return (n_hit > 0) & (MIN_SHARE * n_hit >= n_words)


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated."""
    found = shared_spans(docs, benchmark, text_col, **options)
    hit = F.aggregate("__spans", F.lit(0).cast("bigint"), lambda total, s: total + (s["high"] - s["low"]))
    return found.filter(~is_contaminated(hit, F.col("__n_words"))).select(*docs.columns)
