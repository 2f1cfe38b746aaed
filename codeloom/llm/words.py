"""Words of UTF-8 texts as numpy arrays, for use inside Arrow tasks.

All word rules here depend on ASCII bytes only, so they can be applied to UTF-8 bytes: every byte of a
longer character is 0x80 or more. Arrays grow with the slice of rows in hand, never with a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
_BLOCK = 1 << 20

_CODES = np.arange(256)
#: Words of letters, digits and everything beyond ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
ALNUM = (_CODES >= 0x80) | ((_CODES >= 0x30) & (_CODES <= 0x39)) | ((_CODES | 0x20 >= 0x61) & (_CODES | 0x20 <= 0x7A) & (_CODES >= 0x41))
#: Words between white space: [^\x20\x09-\x0D]+
GRAPHIC = ~((_CODES == 0x20) | ((_CODES >= 0x09) & (_CODES <= 0x0D)))

_ODD = 0x9E3779B97F4A7C15
_LOWER = np.where((_CODES >= 0x41) & (_CODES <= 0x5A), _CODES + 0x20, _CODES)
_MULTIPLIER = 0xD1342543DE82EF95
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))[_LOWER]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the multiplier, and their inverses."""
    if n <= len(_POWERS):
        return _POWERS[:n], _INVERSES[:n]
    return _powers(_MULTIPLIER, n), _powers(_INVERSE, n)


_POWERS = _powers(_MULTIPLIER, _BLOCK + 1)
_INVERSES = _powers(_INVERSE, _BLOCK + 1)


class Slice(NamedTuple):
    """Some rows of a batch: their bytes, and where each row begins and ends in them."""

    first: int
    data: np.ndarray
    bounds: np.ndarray


class Words(NamedTuple):
    """Words of a slice: byte spans, 64-bit hashes, and for each row its range of words."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return pc.fill_null(batch.column(name).cast(pa.large_string()), "")


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """Rows in order, in groups of at most ``most`` bytes; a longer text is a group of its own."""
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
        yield Slice(low, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        low = high


def find_words(piece: Slice, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans of the words, and the range of words of each row. No word spans two rows."""
    data, bounds = piece.data, piece.bounds
    flags = np.zeros(len(data) + 1, bool)
    np.take(is_word, data, out=flags[:-1])
    begins = flags[:-1].copy()
    begins[1:] &= ~flags[:-2]
    edges = bounds[:-1][bounds[:-1] < len(data)]
    begins[edges] = flags[edges]
    starts = np.flatnonzero(begins)
    stops = flags[:-1] & ~flags[1:]
    inner = edges[edges > 0] - 1
    stops[inner] = flags[inner]
    ends = np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each lower-cased word, in blocks of bytes."""
    out = np.empty(len(starts), np.uint64)
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + _BLOCK, "right")))
        begin, end = int(starts[low]), int(ends[high - 1])
        size = end - begin
        powers, inverses = (_POWERS, _INVERSES) if size <= _BLOCK else (_powers(_MULTIPLIER, size + 1), _powers(_INVERSE, size + 1))
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[data[begin:end]] * powers[:size], out=sums[1:])
        s, e = starts[low:high] - begin, ends[low:high] - begin
        out[low:high] = mix((sums[e] - sums[s]) * inverses[s] + (e - s).astype(np.uint64) * np.uint64(_ODD))
        low = high
    return out


def words(piece: Slice, is_word: np.ndarray) -> Words:
    starts, ends, bounds = find_words(piece, is_word)
    return Words(starts, ends, hash_words(piece.data, starts, ends), bounds)


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` values; entry i covers i to i+k-1. Runs over a row's end are the caller's to drop."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:n].copy()
    for j in range(1, k):
        total *= np.uint64(_MULTIPLIER)
        total += hashes[j : j + n]
    return mix(total)


def sequence_hash(hashes: np.ndarray) -> np.uint64:
    """What ``run_hashes`` gives for one run of all the values."""
    return run_hashes(hashes, len(hashes))[0]


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))
