"""Quality scores by Bradley-Terry ranking.

A document has a strength, linear in features of its whole text; in a preference pair (a document labelled 1, one
labelled 0) the first wins with the probability sigmoid(strength difference). The weights minimise the logistic loss on
the feature differences of the pairs. Strengths are relative, so the cut between accepted and rejected documents is a
quantile of the strengths of labelled documents, and the score is a sigmoid that gives ``CUT_SCORE`` at that cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import words as W
from codeloom.llm.learned import SAMPLE_PER_CLASS, held_out, training_rows

#: Documents with a lower score are rejected.
CUT_SCORE = 0.7
PAIRS = 60_000
RIDGE = 1e-3
STEPS = 400

_BYTES = np.arange(256)
_KINDS = {
    "upper": (_BYTES >= 0x41) & (_BYTES <= 0x5A), "lower": (_BYTES >= 0x61) & (_BYTES <= 0x7A), "digit": (_BYTES >= 0x30) & (_BYTES <= 0x39),
    "blank": ~W.GRAPHIC, "line": _BYTES == 0x0A, "stop": np.isin(_BYTES, list(b".,;:")), "bang": np.isin(_BYTES, list(b"!?")),
    "bar": np.isin(_BYTES, list(b"|\t")), "mark": np.isin(_BYTES, list(b"#$%&*+<=>@^_~\\/")), "quote": np.isin(_BYTES, list(b"\"'()[]{}-`")),
    "lead": _BYTES >= 0xC0, "control": (_BYTES < 0x20) & W.GRAPHIC,
}
FEATURES = [*_KINDS, "log_words", "word_length", "repeated_next", "distinct", "commonest", "tripled_bytes", "bare_words"]


def features(piece: W.Slice) -> np.ndarray:
    """One row of features for each text of the slice; shares of bytes or of words, zero for a text without any."""
    found = W.words(piece, W.GRAPHIC)
    data, bounds = piece.data, piece.bounds
    n = len(bounds) - 1
    sizes = np.maximum(np.diff(bounds), 1)
    out = np.zeros((n, len(FEATURES)))

    def per_row(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[bounds[1:]] - total[bounds[:-1]]

    for column, table in enumerate(_KINDS.values()):
        out[:, column] = per_row(table[data]) / sizes
    tripled = np.zeros(len(data), bool)
    if len(data) > 2:
        tripled[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
    counts = np.diff(found.bounds)
    at_least = np.maximum(counts, 1)
    lengths = np.concatenate([[0], np.cumsum(found.ends - found.starts)])
    again = np.zeros(len(found.hashes), bool)
    again[1:] = found.hashes[1:] == found.hashes[:-1]
    again = np.concatenate([[0], np.cumsum(again)])
    alone = np.concatenate([[0], np.cumsum((found.ends - found.starts == 1) & ~W.ALNUM[data[np.minimum(found.starts, max(len(data) - 1, 0))]])]) if len(data) else np.zeros(1)
    base = len(_KINDS)
    out[:, base] = np.log1p(counts)
    out[:, base + 1] = (lengths[found.bounds[1:]] - lengths[found.bounds[:-1]]) / at_least / 10
    out[:, base + 2] = (again[found.bounds[1:]] - again[found.bounds[:-1]]) / at_least
    for row in range(n):
        _, times = np.unique(found.hashes[found.bounds[row] : found.bounds[row + 1]], return_counts=True)
        if len(times):
            # Long texts repeat common words more; the number of distinct words is held against the root of the length.
            out[row, base + 3] = len(times) / counts[row] ** 0.75
            out[row, base + 4] = times.max() / (counts[row] + 5)
    out[:, base + 5] = per_row(tripled) / sizes
    out[:, base + 6] = (alone[found.bounds[1:]] - alone[found.bounds[:-1]]) / at_least
    return out


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.strength(x) - self.cut), -30, 30) - np.log(CUT_SCORE / (1 - CUT_SCORE))))


def fit(good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> Model:
    """Weights from preference pairs drawn from all (good, bad) pairs; without both classes every score is that of the cut."""
    both = np.vstack([good, bad])
    if not len(good) or not len(bad):
        n = both.shape[1]
        return Model(np.zeros(n), np.ones(n), np.zeros(n), 0.0, 1.0)
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-9
    rng = np.random.default_rng(seed)
    g, b = np.clip((good - mean) / scale, -8, 8), np.clip((bad - mean) / scale, -8, 8)
    difference = g[rng.integers(len(g), size=pairs)] - b[rng.integers(len(b), size=pairs)]
    weights = np.zeros(both.shape[1])
    # Newton steps on the ridge-penalised logistic loss.
    for _ in range(STEPS // 20):
        p = 1 / (1 + np.exp(np.clip(difference @ weights, -30, 30)))
        gradient = -(p @ difference) / pairs + RIDGE * weights
        curvature = (difference * (p * (1 - p))[:, None]).T @ difference / pairs + RIDGE * np.eye(len(weights))
        step = np.linalg.solve(curvature, gradient)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    # The cut lies where the rejected share of both classes errs least: between neighbouring quantiles of the two strengths.
    sg, sb = np.sort(g @ weights), np.sort(b @ weights)
    grid = np.unique(np.concatenate([np.quantile(sg, np.linspace(0, 0.2, 201)), np.quantile(sb, np.linspace(0.8, 1, 201))]))
    grid = (grid[1:] + grid[:-1]) / 2 if len(grid) > 1 else grid
    errors = np.searchsorted(sg, grid, "left") / len(sg) + 1 - np.searchsorted(sb, grid, "left") / len(sb)
    best = np.flatnonzero(errors == errors.min())
    cut = float(grid[best[len(best) // 2]])
    return Model(mean, scale, weights, cut, 4 / max(1e-9, float(sg.mean() - cut)))


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in W.slices(W.text_column(batch, "text")):
            x = features(piece)
            yield pa.RecordBatch.from_arrays([batch.column("label").slice(piece.first, len(x)), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE_PER_CLASS) -> Model:
    """Fits on at most ``sample`` documents of each class; only their features come to the driver."""
    rows = training_rows(docs, labels, label_col, id_col, text_col, sample)
    got = rows.mapInArrow(_features_of, "label int, x array<double>").orderBy("label", "x").collect()
    x = {label: np.array([r.x for r in got if r.label == label], float).reshape(-1, len(FEATURES)) for label in (0, 1)}
    return fit(x[1], x[0])


def add_score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``: 0 to 1, higher where label 1 is likelier. Null and empty texts have a score too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(features(piece)) for piece in W.slices(W.text_column(batch, text_col))]
            values = pa.array(np.concatenate(scores) if scores else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, docs.withColumn(name, F.lit(0.0)).schema)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE_PER_CLASS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (1 from ``CUT_SCORE`` on).

    Scores depend on the text alone; other columns are not read. Repeated rows get equal scores. Where the labels lack one
    of the classes every document scores ``CUT_SCORE``, so that nothing is rejected without evidence.
    """
    model = train(docs, labels, id_col, text_col, label_col, sample)
    rows = add_score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT_SCORE).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE_PER_CLASS) -> DataFrame:
    """The rows of ``docs`` that the model accepts, with their own columns."""
    model = train(docs, labels, id_col, text_col, label_col, sample)
    return add_score(docs, model, text_col, "__score").filter(F.col("__score") >= CUT_SCORE).select(*docs.columns)
