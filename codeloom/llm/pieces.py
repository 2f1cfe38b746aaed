"""SentencePiece encoding with sampled segmentations, and decoding.

A text is a lattice of pieces. The forward filter sums the weights of all ways to reach each place; backward sampling then draws
the last piece, the piece before it, and so on, with exactly the probability of the whole segmentation. Every draw is a hash
of the row's key and of the place in the text, so a row gets the same segmentation in any batch, task or cluster.

The lattice falls apart where no piece covers two neighbouring characters; its connected parts repeat a lot, so each distinct
part of a slice is filtered once, and all its occurrences are sampled together, one piece a step.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import words as W

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Rows are decoded and checked in slices of so many bytes, encoded in windows of so many symbols; the lattices of distinct parts of
#: so many symbols are held at a time.
SLICE_BYTES = 1 << 20
WINDOW_SYMBOLS = 256 << 10
GROUP_SYMBOLS = 64 << 10
SPACE = 0x2581
#: A space mark that stands in the text itself; it is spelled in bytes so that decoding can tell it from a space.
LITERAL = 0x110000
FALLBACK_WEIGHT = -20.0
_MULTIPLIER = np.uint64(0xD1342543DE82EF95)
_BUCKET_BITS = 20


class Model(NamedTuple):
    """Tables of a model. Class 0 stands for every character that is in no piece."""

    class_of: np.ndarray
    pair_of: np.ndarray
    joined: np.ndarray
    values: np.ndarray
    prefixes: np.ndarray
    buckets: np.ndarray
    prefix_ids: np.ndarray
    weights: np.ndarray
    single: np.ndarray
    byte_ids: np.ndarray
    spelled: list[bytes]


_POWERS = W._powers(int(_MULTIPLIER), 4096)


def load_model(path: str = MODEL, alpha: float = 1.0) -> Model:
    """Reads a model file on the driver; the tables go to the tasks with the function.

    The weight of a piece is ``alpha`` times its log probability. Models of merges have ranks instead of
    probabilities; a rank r counts as -log(1 + r), after Zipf's law.
    """
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    n = processor.get_piece_size()
    normal = [i for i in range(n) if not (processor.is_byte(i) or processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i))]
    text = {i: processor.id_to_piece(i) for i in normal}
    chars = sorted({c for p in text.values() for c in p})
    class_of = np.zeros(LITERAL + 1, np.int16)
    class_of[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
    # Characters of longer pieces, and which of them stand side by side in a piece.
    inner = sorted({c for p in text.values() if len(p) > 1 for c in p})
    pair_of = np.zeros(len(chars) + 1, np.int16)
    pair_of[class_of[[ord(c) for c in inner]]] = np.arange(1, len(inner) + 1)
    joined = np.zeros((len(inner) + 1, len(inner) + 1), bool)
    for p in text.values():
        kinds = pair_of[class_of[[ord(c) for c in p]]]
        joined[kinds[:-1], kinds[1:]] = True
    values = W.mix(np.arange(1, len(chars) + 2, dtype=np.uint64))
    scores = np.array([processor.get_score(i) for i in range(n)])
    ranked = all(float(scores[i]).is_integer() for i in normal)
    weights = alpha * (-np.log1p(-scores) if ranked else scores)
    known: dict[int, int] = {}
    single = np.full(len(chars) + 1, -1, np.int32)
    for i, p in text.items():
        total, power = 0, 1
        for place, c in enumerate(p):
            total = (total + int(values[class_of[ord(c)]]) * power) % (1 << 64)
            power = power * int(_MULTIPLIER) % (1 << 64)
            known.setdefault(total, -1)
        known[total] = i
        if len(p) == 1:
            single[class_of[ord(p)]] = i
    prefixes = np.array(sorted(known), np.uint64)
    buckets = np.searchsorted(prefixes, np.arange(1 << _BUCKET_BITS, dtype=np.uint64) << np.uint64(64 - _BUCKET_BITS)).astype(np.int32)
    buckets = np.append(buckets, np.int32(len(prefixes)))
    byte_ids = np.array([processor.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
    if (byte_ids == processor.unk_id()).any():
        raise ValueError("The model has no byte fallback, so decoding could not be lossless.")
    spelled = [b""] * n
    for i, p in text.items():
        spelled[i] = p.replace(chr(SPACE), " ").encode()
    for b, i in enumerate(byte_ids):
        spelled[i] = bytes([b])
    return Model(class_of, pair_of, joined, values, prefixes, buckets, np.array([known[int(h)] for h in prefixes], np.int32), weights, single, byte_ids, spelled)


def find_prefixes(model: Model, hashes: np.ndarray) -> np.ndarray:
    """Place of each hash in the sorted prefix table, or -1. The leading bits lead to a bucket of hardly ever two entries."""
    bucket = hashes >> np.uint64(64 - _BUCKET_BITS)
    at, stop = model.buckets[bucket], model.buckets[bucket + np.uint64(1)]
    out = np.full(len(hashes), -1, np.int32)
    left = np.flatnonzero(at < stop)
    while len(left):
        hit = model.prefixes[at[left]] == hashes[left]
        out[left[hit]] = at[left[hit]]
        left = left[~hit]
        at[left] += 1
        left = left[at[left] < stop[left]]
    return out


class Lattice(NamedTuple):
    """Edges of the distinct parts, sorted by end state, with cumulative probabilities of the last piece."""

    reach: np.ndarray
    begin: np.ndarray
    stop: np.ndarray
    source: np.ndarray
    piece: np.ndarray
    length: np.ndarray

    def draw(self, state: np.ndarray, u: np.ndarray) -> np.ndarray:
        """For each end state the edge in whose range of the cumulative probability ``u`` lies."""
        edge, last = self.begin[state], self.stop[state] - 1
        left = np.flatnonzero((self.reach[edge] <= u) & (edge < last))
        while len(left):
            edge[left] += 1
            left = left[(self.reach[edge[left]] <= u[left]) & (edge[left] < last[left])]
        return edge


def build_lattice(model: Model, kinds: np.ndarray, sizes: np.ndarray) -> tuple[Lattice, np.ndarray, np.ndarray]:
    """The lattice of parts that lie one after the other in ``kinds``; first and last state of each part."""
    ends = np.cumsum(sizes, dtype=np.int32)
    first_state = ends - sizes + np.arange(len(sizes), dtype=np.int32)
    part = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    position = np.arange(len(kinds), dtype=np.int32)
    end_of, state_of = ends[part], position + part
    sources, pieces, lengths = [], [], []
    alive, total, length = position, np.zeros(len(kinds), np.uint64), 0
    while len(alive):
        total = total + model.values[kinds[alive + length]] * _POWERS[length]
        length += 1
        at = find_prefixes(model, total)
        piece = np.where(at >= 0, model.prefix_ids[at], -1)
        whole = piece >= 0 if length > 1 else np.ones(len(alive), bool)
        sources.append(state_of[alive[whole]])
        pieces.append(piece[whole])
        lengths.append(np.full(int(whole.sum()), length, np.int32))
        on = np.flatnonzero((at >= 0) & (alive + length < end_of[alive]))
        alive, total = alive[on], total[on]
    # Longest pieces first: they are likely ones. Each length is in order already, so sorting merges few runs.
    source, piece, size = (np.concatenate(x[::-1]) for x in (sources, pieces, lengths))
    order = np.argsort(source + size, kind="stable")
    source, piece, size = source[order], piece[order], size[order]
    target = source + size
    weight = np.where(piece >= 0, model.weights[piece], FALLBACK_WEIGHT)
    n_states = len(kinds) + len(sizes)
    step = target - np.repeat(first_state, sizes + 1)[target]
    by_step = np.argsort(step.astype(np.int16) if step.max() < 1 << 15 else step, kind="stable").astype(np.int32)
    total_weight = np.zeros(n_states)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(step))])[1:]
    del order, step, end_of, state_of, part
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        edge = by_step[low:high]
        value = total_weight[source[edge]] + weight[edge]
        goal = target[edge]
        new = np.flatnonzero(np.concatenate([[True], goal[1:] != goal[:-1]]))
        most = np.maximum.reduceat(value, new)
        spread = np.exp(value - np.repeat(most, np.diff(np.append(new, len(value)))))
        total_weight[goal[new]] = most + np.log(np.add.reduceat(spread, new))
    chance = np.exp(total_weight[source] + weight - total_weight[target])
    running = np.cumsum(chance)
    counts = np.bincount(target, minlength=n_states)
    stop = np.cumsum(counts)
    begin = stop - counts
    before = np.concatenate([[0.0], running])[begin]
    return Lattice(running - before[target], begin, stop, source, piece, size), first_state, first_state + sizes


def uniform(keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A number in [0, 1) for each key and place."""
    return (W.mix(keys + (places.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) * 2.0**-53


def _window(model: Model, text: str, edges_at: np.ndarray, final: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of a window and where it falls apart; ``edges_at`` are row ends in it. The end of a window inside a text is no cut."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int32)
    literal, blank = codes == SPACE, codes == 0x20
    codes[literal], codes[blank] = LITERAL, SPACE
    kinds = model.class_of[codes]
    pairs = model.pair_of[kinds]
    cut = np.ones(len(codes) + 1, bool)
    cut[1:-1] = ~model.joined[pairs[:-1], pairs[1:]]
    cut[-1] = final
    cut[edges_at] = True
    return codes, kinds, np.flatnonzero(cut).astype(np.int32)


def _segment(model: Model, kinds: np.ndarray, edges: np.ndarray, key: np.ndarray, base: np.ndarray) -> np.ndarray:
    """The piece that begins at each symbol: -2 for none, -1 for a symbol in no piece. ``key`` and ``base`` belong to the parts."""
    begins, sizes = edges[:-1], np.diff(edges)
    chosen = np.full(len(kinds), -2, np.int32)
    lone = begins[sizes == 1]
    chosen[lone] = model.single[kinds[lone]]
    long = sizes > 1
    begins, sizes, key, base = begins[long], sizes[long], key[long], base[long]
    if not len(begins):
        return chosen
    starts = np.cumsum(sizes, dtype=np.int32) - sizes
    place = np.arange(int(sizes.sum()), dtype=np.int32) - np.repeat(starts, sizes)
    own = kinds[np.repeat(begins, sizes) + place]
    hashes = np.add.reduceat(model.values[own] * W._powers(int(_MULTIPLIER), int(sizes.max()))[place], starts)
    del place, own
    _, sample, which = np.unique(W.mix(hashes) + sizes.astype(np.uint64), return_index=True, return_inverse=True)
    # Lattices of some distinct parts at a time, and all draws from them.
    group = np.cumsum(sizes[sample]) // GROUP_SYMBOLS
    order = np.argsort(group[which], kind="stable")
    bounds = np.searchsorted(group[which][order], np.arange(int(group[-1]) + 2))
    first_of = np.searchsorted(group, np.arange(int(group[-1]) + 2))
    for g in range(int(group[-1]) + 1):
        own = slice(first_of[g], first_of[g + 1])
        lengths = sizes[sample[own]]
        if not len(lengths):
            continue
        inside = np.arange(int(lengths.sum()), dtype=np.int32) - np.repeat(np.cumsum(lengths, dtype=np.int32) - lengths, lengths)
        lattice, first, last = build_lattice(model, kinds[np.repeat(begins[sample[own]], lengths) + inside], lengths)
        drawn = order[bounds[g] : bounds[g + 1]]
        part = which[drawn] - own.start
        state, start, at, k, b = last[part], first[part], begins[drawn] + sizes[drawn], key[drawn], base[drawn]
        while len(state):
            edge = lattice.draw(state, uniform(k, at - b))
            at = at - lattice.length[edge]
            chosen[at] = lattice.piece[edge]
            state = lattice.source[edge]
            on = state > start
            state, start, at, k, b = state[on], start[on], at[on], k[on], b[on]
    return chosen


def _spell(model: Model, ids: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``ids`` with the bytes of symbols in no piece, and where the ids of each symbol begin."""
    spelled = np.flatnonzero(ids == -1)
    if not len(spelled):
        return ids, np.arange(len(ids) + 1)
    code = codes[spelled]
    code = np.where(code == LITERAL, SPACE, np.where(code == SPACE, 0x20, code))
    width = np.ones(len(ids), np.int64)
    width[spelled] = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
    ids = np.repeat(ids, width)
    ids[ids == -1] = model.byte_ids[np.frombuffer("".join(map(chr, code)).encode(), np.uint8)]
    return ids, np.concatenate([[0], np.cumsum(width)])


def encode_texts(model: Model, texts: list[str], keys: np.ndarray, window: int = WINDOW_SYMBOLS) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, and where each text's ids begin; ``keys`` are 64-bit hashes of the row keys.

    Works through windows that end where the lattice falls apart, so memory follows the window and not the longest text.
    """
    parts = [" " + t if t else "" for t in texts]
    rows = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
    whole = "".join(parts)
    del parts
    found, counts, low, width = [], np.zeros(len(texts), np.int64), 0, window
    while low < len(whole):
        high = min(low + width, len(whole))
        inner = rows[np.searchsorted(rows, low) : np.searchsorted(rows, high, "right")] - low
        codes, kinds, edges = _window(model, whole[low:high], inner, high == len(whole))
        size = int(edges[-1])
        if not size:
            # No cut in the window: a longer one.
            width *= 2
            continue
        row = np.searchsorted(rows, low + edges[:-1], "right") - 1
        chosen = _segment(model, kinds[:size], edges, keys[row], rows[row] - low)
        used = np.flatnonzero(chosen > -2)
        ids, starts = _spell(model, chosen[used], codes[used])
        found.append(ids)
        # Rows that the window touches, by the places where they begin or go on in it.
        touched = np.arange(row[0], row[-1] + 1)
        ends = np.minimum(rows[touched + 1] - low, size)
        at = starts[np.searchsorted(used, ends)]
        counts[touched] += np.diff(at, prepend=0)
        low, width = low + size, window
    return (np.concatenate(found) if found else np.zeros(0, np.int32)), np.concatenate([[0], np.cumsum(counts)])


def decode_ids(model: Model, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Bytes of each row; the space that encoding put in front is taken off."""
    pieces = [model.spelled[i] for i in ids.tolist()]
    sizes = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
    whole = b"".join(pieces)
    return [whole[sizes[a] + 1 : sizes[b]] if b > a else b"" for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL, alpha: float = 1.0, seed: int = 0
) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (one sampled segmentation of the whole text), lossless.

    The same id, text and seed give the same ids; ``alpha`` sharpens (above 1) or flattens (below 1) the distribution. A null or
    empty text has no pieces. ``lossless`` tells that decoding the ids gave the text's exact bytes. Other columns are not read.
    """
    model = load_model(path, alpha)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(seed)).alias("key"),
        F.col(text_col).alias("text"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, keys = W.text_column(batch, "text"), batch.column("key").to_numpy().view(np.uint64)
            for piece in W.slices(column, SLICE_BYTES):
                n = len(piece.bounds) - 1
                ids, bounds = encode_texts(model, column.slice(piece.first, n).to_pylist(), keys[piece.first : piece.first + n])
                whole = piece.data.tobytes()
                same = [d == whole[a:b] for d, a, b in zip(decode_ids(model, ids, bounds), piece.bounds[:-1], piece.bounds[1:], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(piece.first, n), lists, pa.array(same)], names=["doc_id", "ids", "lossless"])

    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, lossless boolean")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = MODEL) -> DataFrame:
    """(doc_id, text) from piece ids; null ids give an empty text, bytes that are no UTF-8 the replacement character."""
    model = load_model(path)
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            texts = decode_ids(model, lists.flatten().to_numpy(zero_copy_only=False), bounds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t.decode(errors="replace") for t in texts], pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {kind}, text string")
