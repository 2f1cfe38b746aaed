"""Token counts by offset-mapped attribution.

A document is encoded once, as a whole, so tokens are those that training sees. The byte spans of the tokens are then joined to
the spans of the document's sections; both lists are sorted, so the interval join is one binary search for each token end.
A token that crosses a boundary is given to one section, or divided, by a stated rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm import words as W

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits texts before merges, as published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("first", "most", "share")


def line_sections(text: Column) -> Column:
    """Sections as (start, end) in characters: every line with its line end. A text without lines is one empty section."""
    lines = F.split(F.coalesce(text, F.lit("")), "(?<=\n)")
    lines = F.when(F.size(lines) > 1, F.filter(lines, lambda line: line != "")).otherwise(lines)
    ends = F.aggregate(
        lines, F.array().cast("array<bigint>"),
        lambda done, line: F.array_append(done, F.coalesce(F.element_at(done, -1), F.lit(0)) + F.length(line)),
    )
    return F.transform(ends, lambda end, n: F.struct((end - F.length(F.get(lines, n))).alias("start"), end.alias("end")))


def line_bounds(data: np.ndarray) -> np.ndarray:
    """Byte positions where the lines of a text begin, and its end."""
    ends = np.flatnonzero(data == 0x0A) + 1
    return np.concatenate([[0], ends[ends < len(data)], [len(data)]]).astype(np.int64)


def attribute(token_ends: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section and how many of them cross one of its ends. Spans are in bytes; sections are sorted and disjoint.

    first: the section that holds the token's first byte. most: the one that holds most of its bytes, the earlier of equals.
    share: each section gets the share of the token's bytes that it holds. Bytes outside of all sections count for none.
    """
    begins = np.concatenate([[0], token_ends[:-1]]) if len(token_ends) else token_ends
    low = np.searchsorted(ends, begins, "right")
    high = np.searchsorted(starts, token_ends, "left") - 1
    width = np.maximum(high - low + 1, 0)
    token = np.repeat(np.arange(len(token_ends)), width)
    section = np.repeat(low, width) + np.arange(len(token)) - np.repeat(np.cumsum(width) - width, width)
    overlap = np.minimum(token_ends[token], ends[section]) - np.maximum(begins[token], starts[section])
    token, section, overlap = token[overlap > 0], section[overlap > 0], overlap[overlap > 0]
    size = (token_ends - begins)[token]
    crossing = overlap < size
    if rule == "share":
        return np.bincount(section, overlap / size, len(starts)), np.bincount(section, crossing, len(starts)).astype(np.int64)
    if rule == "first":
        keep = starts[section] <= begins[token]
    else:
        # Of each token the largest overlap, then the earliest section: the first after sorting.
        order = np.lexsort((section, -overlap, token))
        token, section, crossing = token[order], section[order], crossing[order]
        keep = np.concatenate([[True], token[1:] != token[:-1]]) if len(token) else np.zeros(0, bool)
    section, crossing = section[keep], crossing[keep]
    return np.bincount(section, minlength=len(starts)).astype(float), np.bincount(section, crossing, len(starts)).astype(np.int64)


def load_encoding(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None, rule: str = "most", path: str = RANKS
) -> DataFrame:
    """One row per section of each row of ``docs``: doc_id, section (from 0), start, end (bytes), n_tokens, n_crossing, doc_tokens.

    Sections are lines with their line ends, or ``sections_col``: array<struct<start, end>> in characters, sorted and disjoint.
    An empty or null text has one empty section without tokens (none where ``sections_col`` is empty or null). n_tokens is a
    double: whole for the rules first and most. Repeated rows give repeated results. Other columns are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}.")
    chosen = [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")]
    if sections_col:
        plain = F.transform(F.col(sections_col), lambda s: F.array(s["start"].cast("bigint"), s["end"].cast("bigint")))
        chosen.append(F.flatten(F.coalesce(plain, F.array().cast("array<array<bigint>>"))).alias("sections"))
    rows = docs.select(*chosen)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(path)
        sizes = np.zeros(encoding.n_vocab, np.int64)
        for token, rank in encoding._mergeable_ranks.items():
            sizes[rank] = len(token)
        for batch in batches:
            column = W.text_column(batch, "text")
            for piece in W.slices(column):
                texts = column.slice(piece.first, len(piece.bounds) - 1).to_pylist()
                out: list[list[np.ndarray]] = []
                for n, text in enumerate(texts):
                    data = piece.data[piece.bounds[n] : piece.bounds[n + 1]]
                    if sections_col:
                        places = np.array(batch.column("sections")[piece.first + n].as_py(), np.int64)
                        # Character positions become byte positions: a character begins at every byte but 10xxxxxx.
                        begins = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
                        spots = begins[np.clip(places, 0, len(begins) - 1)]
                        starts, ends = spots[0::2], spots[1::2]
                    else:
                        spots = line_bounds(data)
                        starts, ends = spots[:-1], spots[1:]
                    ids = np.array(encoding.encode_ordinary(text), np.int64)
                    counts, crossing = attribute(np.cumsum(sizes[ids]), starts, ends, rule)
                    m = len(starts)
                    out.append([np.full(m, piece.first + n), np.arange(m, dtype=np.int32), starts, ends, counts, crossing, np.full(m, len(ids))])
                columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(columns[0])), *(pa.array(c) for c in columns[1:])],
                    names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"],
                )

    return rows.mapInArrow(run, f"doc_id {kind}, section int, start bigint, end bigint, n_tokens double, n_crossing bigint, doc_tokens bigint")
