"""Toxicity by cumulative-link ordinal regression.

A severity grade of 0 to ``GRADES`` - 1 is predicted with P(grade >= k) = sigmoid(w.x - t_k): one weight vector for all
thresholds t_1 < t_2 < ... The features are sparse: whether each of a few thousand words stands in the text, and how often.
Labels tell toxic documents from others only. Their grade is derived: 0 without the label, and with it 1 to
``GRADES`` - 1 by how often words of the model stand in the text.
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

GRADES = 4
#: Most words that enter the model.
VOCABULARY = 1_024
#: A word is a feature if the classes differ in its share by this likelihood ratio and this log-odds.
MIN_RATIO = 20.0
MIN_LOG_ODDS = 2.0
RIDGE = 5e-5
STEPS = 1_000


class Model(NamedTuple):
    """Sorted word hashes, their weights, the thresholds, and the score from which a document counts as toxic."""

    vocabulary: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float

    def at_least(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return 1 / (1 + np.exp(-np.clip((x @ self.weights)[:, None] - self.thresholds[None, :], -30, 30)))


def _word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels, sets, counts, totals = batch.column("label").to_pylist(), [], [], []
        for piece in W.slices(W.text_column(batch, "text")):
            found = W.words(piece, W.ALNUM)
            for low, high in zip(found.bounds[:-1], found.bounds[1:], strict=True):
                values, times = np.unique(found.hashes[low:high], return_counts=True)
                sets.append(values.view(np.int64))
                counts.append(times)
                totals.append(int(high - low))
        yield pa.RecordBatch.from_arrays(
            [pa.array(labels, pa.int32()), pa.array(sets, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64())), pa.array(totals, pa.int64())],
            names=["label", "tokens", "times", "total"],
        )


def amounts(times: np.ndarray) -> np.ndarray:
    """Feature of a word that stands so often: 1 at once, growing slowly."""
    return np.where(times > 0, 1 + np.log(np.maximum(times, 1)), 0.0)


def choose_words(sets: list[np.ndarray], toxic: np.ndarray, most: int = VOCABULARY) -> np.ndarray:
    """Words that tell toxic documents from others, sorted; chosen one after the other.

    Each choice is the word with the largest likelihood ratio between the toxic documents that hold no chosen word yet and all
    other documents. A word that only comes with a group of copies is passed over once the cause of their label is chosen.
    """
    if not sets:
        return np.zeros(0, np.uint64)
    words, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bad = toxic[owner] > 0
    inside = np.bincount(place[bad], minlength=len(words))
    outside = np.bincount(place[~bad], minlength=len(words)) - 0.0
    n_out = float((toxic == 0).sum())
    # Only entries of words that can still be chosen, in toxic documents.
    maybe = inside * n_out > outside * toxic.sum() * np.exp(MIN_LOG_ODDS)
    keep = bad & maybe[place]
    place, owner = place[keep], owner[keep]
    chosen: list[int] = []
    open_docs = toxic > 0
    while len(chosen) < most and open_docs.any():
        seen = np.bincount(place[open_docs[owner]], minlength=len(words))
        ratio = _evidence(seen, float(open_docs.sum()), outside, n_out)
        best = int(np.argmax(ratio))
        if ratio[best] < MIN_RATIO:
            break
        chosen.append(best)
        open_docs[owner[place == best]] = False
    # Words that only stand beside chosen ones: counted once for each combination of chosen words, which copies share.
    is_chosen = np.zeros(len(words), bool)
    is_chosen[chosen] = True
    mark = np.where(is_chosen[place], W.mix(words[place]), np.uint64(0))
    combination = np.zeros(len(sets), np.uint64)
    np.add.at(combination, owner, mark)
    pairs = np.unique(np.rec.fromarrays([place, combination[owner]]))
    seen = np.bincount(pairs["f0"], minlength=len(words))
    ratio = _evidence(seen, float((toxic > 0).sum()), outside, n_out)
    more = [int(n) for n in np.argsort(-ratio, kind="stable")[:most] if ratio[n] >= MIN_RATIO and not is_chosen[n]]
    return words[np.sort([*chosen, *more][:most])] if chosen else np.zeros(0, np.uint64)


def _evidence(seen: np.ndarray, n_in: float, outside: np.ndarray, n_out: float) -> np.ndarray:
    """Likelihood ratio of "a share for each class" against "one share for both"; 0 where the log-odds are too small."""
    share = (seen + outside) / (n_in + n_out)
    ratio = np.zeros(len(seen))
    for k, n in ((seen, n_in), (outside, n_out)):
        for part, expected in ((k, n * share), (n - k, n * (1 - share))):
            ratio += 2 * np.where(part > 0, part * np.log(np.maximum(part, 1e-9) / np.maximum(expected, 1e-9)), 0.0)
    odds = np.log((seen + 0.5) / (n_in - seen + 0.5)) - np.log((outside + 0.5) / (n_out - outside + 0.5))
    return np.where(odds < MIN_LOG_ODDS, 0.0, ratio)


def fit(x: np.ndarray, grades: np.ndarray, n_grades: int = GRADES) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by gradient descent with Adam steps on the cumulative logistic loss; classes weigh the same."""
    share = np.bincount(grades > 0, minlength=2)
    importance = np.where(grades > 0, 0.5 / max(share[1], 1), 0.5 / max(share[0], 1))
    above = (grades[:, None] >= np.arange(1, n_grades)[None, :]).astype(float)
    # Thresholds are a start and positive steps, so they stay in order.
    theta = np.concatenate([np.zeros(x.shape[1]), [1.0], np.zeros(n_grades - 2)])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        weights, steps = theta[: x.shape[1]], np.exp(theta[x.shape[1] + 1 :])
        thresholds = theta[x.shape[1]] + np.concatenate([[0.0], np.cumsum(steps)])
        wrong = (1 / (1 + np.exp(-np.clip((x @ weights)[:, None] - thresholds, -30, 30))) - above) * importance[:, None]
        by_threshold = -wrong.sum(axis=0)
        gradient = np.concatenate([
            x.T @ wrong.sum(axis=1) + RIDGE * weights, [by_threshold.sum()],
            [by_threshold[k + 1 :].sum() * steps[k] for k in range(n_grades - 2)],
        ])
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        theta -= 0.2 * (1 - step / (STEPS + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights, steps = theta[: x.shape[1]], np.exp(theta[x.shape[1] + 1 :])
    return weights, theta[x.shape[1]] + np.concatenate([[0.0], np.cumsum(steps)])


def _grade(hits: np.ndarray, toxic: np.ndarray, n_grades: int) -> np.ndarray:
    """0, or for toxic documents 1 and up by quantiles of the number of hits."""
    inner = np.quantile(hits[toxic > 0], np.linspace(0, 1, n_grades)[1:-1]) if toxic.any() else np.zeros(n_grades - 2)
    return np.where(toxic > 0, 1 + np.searchsorted(inner, hits, "left"), 0)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE_PER_CLASS) -> Model:
    """Fits on at most ``sample`` documents of each class; their distinct word hashes come to the driver."""
    rows = training_rows(docs, labels, label_col, id_col, text_col, sample)
    got = rows.mapInArrow(_word_sets, "label int, tokens array<bigint>, times array<bigint>, total bigint").toArrow()
    return fit_model(
        got.column("label").to_numpy().astype(np.int64),
        [np.array(v, np.int64).view(np.uint64) for v in got.column("tokens").to_pylist()],
        [np.array(v, np.int64) for v in got.column("times").to_pylist()],
        got.column("total").to_numpy(),
    )


def fit_model(toxic: np.ndarray, tokens: list[np.ndarray], times: list[np.ndarray], totals: np.ndarray) -> Model:
    if not toxic.any() or toxic.all():
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.full(GRADES - 1, 30.0), 0.5)
    # The order of rows must not matter.
    order = sorted(range(len(tokens)), key=lambda n: (toxic[n], totals[n], tokens[n].tobytes()))
    toxic, tokens, times, totals = toxic[order], [tokens[n] for n in order], [times[n] for n in order], totals[order]
    vocabulary = choose_words(tokens, toxic)
    x, hits = np.zeros((len(tokens), len(vocabulary)), np.float32), np.zeros(len(tokens))
    if len(vocabulary):
        for n, (own, often) in enumerate(zip(tokens, times, strict=True)):
            at = np.minimum(np.searchsorted(vocabulary, own), len(vocabulary) - 1)
            hit = vocabulary[at] == own
            x[n, at[hit]] = amounts(often[hit])
            hits[n] = often[hit].sum()
    weights, thresholds = fit(x, _grade(hits, toxic, GRADES))
    model = Model(vocabulary, weights, thresholds, 0.5)
    # The cut is the score between the classes that errs least; the middle of the best range.
    score = model.at_least(x)[:, 0]
    clean, bad = np.sort(score[toxic == 0]), np.sort(score[toxic > 0])
    grid = np.linspace(0.05, 0.95, 181)
    errors = 1 - np.searchsorted(clean, grid, "left") / len(clean) + np.searchsorted(bad, grid, "left") / len(bad)
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    return model._replace(cut=float(grid[best[len(best) // 2]]))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in W.slices(W.text_column(batch, "text")):
                found = W.words(piece, W.ALNUM)
                n, v = len(found.bounds) - 1, len(model.vocabulary)
                logit = np.zeros(n)
                if v and len(found.hashes):
                    at = np.minimum(np.searchsorted(model.vocabulary, found.hashes), v - 1)
                    hit = np.flatnonzero(model.vocabulary[at] == found.hashes)
                    row = np.searchsorted(found.bounds, hit, "right") - 1
                    cells, times = np.unique(row * v + at[hit], return_counts=True)
                    logit = np.bincount(cells // v, weights=model.weights[cells % v] * amounts(times), minlength=n)
                p = 1 / (1 + np.exp(-np.clip(logit[:, None] - model.thresholds[None, :], -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(piece.first, n), pa.array(p[:, 0]), pa.array(p.sum(axis=1)), pa.array((p > 0.5).sum(axis=1).astype(np.int32)), pa.array((p[:, 0] >= model.cut).astype(np.int32))],
                    names=["doc_id", "score", "severity", "grade", "predicted"],
                )

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE_PER_CLASS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (P(grade >= 1)), severity (expected grade), grade, predicted.

    ``predicted`` is 1 for toxic documents. Scores depend on the whole text alone; null and empty texts have no words and get
    the score of a text without any known word. Without labels of both classes nothing is predicted toxic.
    """
    model = train(docs, labels, id_col, text_col, label_col, sample)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(_score(model), f"doc_id {kind}, score double, severity double, grade int, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "severity", "grade", "predicted")
