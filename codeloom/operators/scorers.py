"""User-supplied models as scorers: they see batches of texts, Spark does the rest.

The scores of a text stay one array in the order of the codes until they are decoded: nothing is shuffled, and a text goes to Python
once, however many codes it is paired with.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import batched, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pairs import PAIR_CLASSES, literal_leaves

MultilabelModel = Callable[[list[str]], np.ndarray]
PairModel = Callable[[list[str], list[str]], np.ndarray]


def multilabel_arrays(df: DataFrame, model: MultilabelModel, classes: list[str], batch_size: int = 64) -> DataFrame:
    """``(row_id, scores)``: P(code) of each text in the order of ``classes``. ``df`` has ``row_id, text, answer``; a blank answer scores 0.

    ``model`` maps texts to a matrix with a column per class. Blank answers are not sent to it.
    """
    row_type = df.schema["row_id"].dataType.simpleString()
    width = len(classes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            filled = batch["filled"].to_numpy()
            texts = batch["text"][filled].tolist()
            scores = np.zeros((len(batch), width))
            parts = [np.asarray(model(texts[i : i + batch_size]), dtype=np.float64) for i in range(0, len(texts), batch_size)]
            if parts:
                scores[filled] = np.vstack(parts)
            yield pd.DataFrame({"row_id": batch["row_id"], "scores": list(scores)})

    filled = F.coalesce(F.col("answer") != "", F.lit(False)).alias("filled")
    return df.select("row_id", F.when(filled, F.col("text")).alias("text"), filled).mapInPandas(run, f"row_id {row_type}, scores array<double>")


def score_multilabel(df: DataFrame, model: MultilabelModel, classes: list[str], batch_size: int = 64) -> DataFrame:
    """As ``multilabel_arrays``, in long form."""
    names = F.array(*[F.lit(c) for c in classes])
    cells = F.arrays_zip(names.alias("code"), F.col("scores").alias("score"))
    return multilabel_arrays(df, model, classes, batch_size).select("row_id", F.explode(cells).alias("c")).select("row_id", "c.code", "c.score")


def pair_codes(codebook: DataFrame) -> list[str]:
    """The codes that a text is paired with, in the order of the codebook."""
    return [leaf["code"] for leaf in literal_leaves(codebook)]


def pair_arrays(df: DataFrame, codebook: DataFrame, model: PairModel, batch_size: int = 64) -> DataFrame:
    """``(row_id, probs)``: four class probabilities for each code of the codebook (``pair_codes``), whatever codebook the model was trained with.

    ``df`` has ``row_id, text, answer``. The descriptions travel with the function; the batches of ``batch_size`` pairs are formed in the task. A
    blank answer is not sent to the model: every code is absent for sure.
    """
    row_type = df.schema["row_id"].dataType.simpleString()
    descriptions = [leaf["description"] for leaf in literal_leaves(codebook)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            filled = batch["filled"].to_numpy()
            probs = np.zeros((len(batch), len(descriptions), PAIR_CLASSES))
            probs[:, :, 0] = 1.0
            parts = []
            for some in batched(product(batch["text"][filled], descriptions), batch_size):
                texts, described = zip(*some, strict=True)
                parts.append(np.asarray(model(list(texts), list(described)), dtype=np.float64))
            if parts:
                probs[filled] = np.vstack(parts).reshape(-1, len(descriptions), PAIR_CLASSES)
            yield pd.DataFrame({"row_id": batch["row_id"], "probs": list(probs.reshape(len(batch), -1))})

    filled = F.coalesce(F.col("answer") != "", F.lit(False)).alias("filled")
    flat = df.select("row_id", F.when(filled, F.col("text")).alias("text"), filled).mapInPandas(run, f"row_id {row_type}, probs array<double>")
    starts = F.sequence(F.lit(0), F.lit(len(descriptions) - 1))
    return flat.select("row_id", F.transform(starts, lambda i: F.slice("probs", i * PAIR_CLASSES + 1, F.lit(PAIR_CLASSES))).alias("probs"))


def long_pairs(scored: DataFrame, codes: list[str]) -> DataFrame:
    """``(row_id, code, probs)`` from ``pair_arrays``."""
    names = F.array(*[F.lit(c) for c in codes])
    cells = F.arrays_zip(names.alias("code"), F.col("probs").alias("probs"))
    return scored.select("row_id", F.explode(cells).alias("c")).select("row_id", "c.code", "c.probs")


def score_pairs(pairs: DataFrame, model: PairModel, batch_size: int = 64) -> DataFrame:
    """Four class probabilities of the pairs of a table (``row_id, code, text, answer, code_description``), for drawn pairs; a blank answer is absent for sure."""
    row_type = pairs.schema["row_id"].dataType.simpleString()
    filled = pairs.where(F.col("answer") != "").select("row_id", "code", "text", "code_description")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, descriptions = batch["text"].tolist(), batch["code_description"].tolist()
            parts = [
                np.asarray(model(texts[i : i + batch_size], descriptions[i : i + batch_size]), dtype=np.float64)
                for i in range(0, len(texts), batch_size)
            ]
            if parts:
                yield pd.DataFrame({"row_id": batch["row_id"], "code": batch["code"], "probs": list(np.vstack(parts))})

    scored = filled.mapInPandas(run, f"row_id {row_type}, code string, probs array<double>")
    absent = F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    blank = pairs.where(F.col("answer") == "").select("row_id", "code", absent.alias("probs"))
    return scored.unionByName(blank)


def rescore(responses: DataFrame, codebook: DataFrame, model: PairModel, batch_size: int = 64) -> DataFrame:
    """Scores against the codes of the given codebook, in long form."""
    return long_pairs(pair_arrays(responses, codebook, model, batch_size), pair_codes(codebook))
