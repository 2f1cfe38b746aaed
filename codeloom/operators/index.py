"""Embedding index: centroids, nearest-centroid classification, nearest examples."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import format_nearest, with_prefix
from ..functions.vectors import l2_normalize
from ..settings import MAX_BROADCAST_BYTES, materialize
from .block_search import BLOCK_ROWS, BlockSearch
from .decode import INDEX_RULES, accepted, prediction_columns
from .features import char_wb_ngrams
from .responses import require_columns, require_rows, single_label

Encoder = Callable[[list[str]], np.ndarray]


@dataclass
class EmbeddingIndex:
    examples: DataFrame  # example_id, row_id, text, codes…, embedding
    code_centroids: DataFrame
    parent_centroids: DataFrame
    codebook: DataFrame
    config: dict = field(default_factory=dict)


# ---- encoding --------------------------------------------------------------------------------


def encode(df: DataFrame, col: str, encoder: Encoder | None = None, batch_size: int = 64, prefix: str = "", dim: int = 256) -> DataFrame:
    """Adds a unit-length column ``embedding``.

    ``encoder`` maps a list of texts to a matrix and runs on Arrow batches inside the tasks.
    Without one, texts become hashed character n-gram counts, in SQL functions only.
    """
    if batch_size < 1:
        raise ValueError("A batch needs at least one text.")
    if encoder is None:
        return _hashed_embedding(df, col, prefix, dim)
    texts = df.withColumn("_input", with_prefix(F.col(col), prefix))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", embedding array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            inputs = batch.pop("_input").tolist()
            parts = [np.asarray(encoder(inputs[i : i + batch_size]), dtype=np.float64) for i in range(0, len(inputs), batch_size)]
            if parts:
                matrix = np.vstack(parts)
                matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
                batch["embedding"] = list(matrix.astype(np.float32))
                yield batch

    return texts.mapInPandas(run, schema)


def _hashed_embedding(df: DataFrame, col: str, prefix: str, dim: int) -> DataFrame:
    """Counts of character trigrams by hash slot, inside the row."""
    grams = df.withColumn("_grams", char_wb_ngrams(with_prefix(F.col(col), prefix), 3, 3))
    hashed = HashingTF(inputCol="_grams", outputCol="_tf", numFeatures=dim).transform(grams)
    return hashed.withColumn("embedding", l2_normalize(vector_to_array("_tf")).cast("array<float>")).drop("_grams", "_tf")


# ---- centroids -------------------------------------------------------------------------------


def _centroids(examples: DataFrame, key: str, *aggs) -> DataFrame:
    """Mean of unit vectors per ``key``, again of unit length.

    The mean is a partial aggregation: each task sends one vector per code.
    """
    unit = examples.withColumn("_v", array_to_vector(l2_normalize(F.col("embedding"))))
    mean = vector_to_array(Summarizer.mean(F.col("_v")))
    grouped = unit.groupBy(key).agg(mean.alias("_mean"), F.count("*").alias("n_examples"), *aggs)
    return grouped.withColumn("centroid", l2_normalize(F.col("_mean"))).drop("_mean")


def code_centroids(examples: DataFrame, codebook: DataFrame | None = None) -> DataFrame:
    """``code, code_name, parent_code, parent_name, n_examples, centroid``; names from the codebook first."""
    stored = [F.first(c).alias(f"_{c}") for c in ("code_name", "parent_code", "parent_name") if c in examples.columns]
    table = _centroids(examples, "code", *stored)
    for c in ("code_name", "parent_code", "parent_name"):
        if f"_{c}" not in table.columns:
            table = table.withColumn(f"_{c}", F.lit(""))
    if codebook is not None:
        dims = codebook.select("code", F.col("name").alias("_n"), F.col("parent_code").alias("_p"), F.col("parent_name").alias("_pn"))
        table = table.join(dims, "code", "left").withColumns({
            "_code_name": F.coalesce("_n", "_code_name"), "_parent_code": F.coalesce("_p", "_parent_code"),
            "_parent_name": F.coalesce("_pn", "_parent_name"),
        })
    return table.select(
        "code", F.col("_code_name").alias("code_name"), F.col("_parent_code").alias("parent_code"),
        F.col("_parent_name").alias("parent_name"), "n_examples", "centroid",
    )


def parent_centroids(examples: DataFrame) -> DataFrame:
    """As for codes, by parent over the long table: a response with two codes of a parent counts twice."""
    children = F.array_join(F.array_sort(F.collect_set("code")), ", ")  # codes of one parent
    name = F.first("parent_name") if "parent_name" in examples.columns else F.lit("")
    return _centroids(examples, "parent_code", name.alias("parent_name"), children.alias("child_codes"))


def single_label_centroids(examples: DataFrame, level: str = "code") -> DataFrame:
    kept = single_label(examples)
    return code_centroids(kept) if level == "code" else parent_centroids(kept)


# ---- similarity ------------------------------------------------------------------------------


def blocked_top_k(queries: DataFrame, candidates: DataFrame, keys: list[str], k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The ``k`` most similar candidates of each query among those with the same ``keys``: exact, ties by ``cand_id``.

    ``queries`` has keys, ``row_id, vector``; ``candidates`` has keys, ``cand_id, vector``. See ``block_search``.
    """
    return BlockSearch(candidates, keys, block_rows).top_k(queries, k)


def _broadcast_matrix(centroids: DataFrame) -> tuple[list, np.ndarray] | None:
    """Centroids on the driver if a count proves them small enough, else None."""
    shape = centroids.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("centroid")), F.lit(0)).alias("d")).collect()[0]
    if shape["n"] * shape["d"] * 8 > MAX_BROADCAST_BYTES:
        return None
    rows = centroids.select("code", "centroid").orderBy("code").collect()
    return [r["code"] for r in rows], np.array([r["centroid"] for r in rows], dtype=np.float64)


def top_centroids(df: DataFrame, centroids: DataFrame, top_k: int | None = None) -> DataFrame:
    """``(row_id, ranked)``: the ``top_k`` most similar codes of each row, best first; all when None.

    Centroids of checked size are broadcast, and each Arrow batch is one matrix product without
    any shuffle. A larger set goes through ``blocked_top_k`` with one key.
    """
    row_type = df.schema["row_id"].dataType.simpleString()
    small = _broadcast_matrix(centroids)
    if small is None:
        n = top_k or centroids.count()
        queries = df.select(F.lit(0).alias("_all"), "row_id", F.col("embedding").cast("array<double>").alias("vector"))
        cands = centroids.select(F.lit(0).alias("_all"), F.col("code").alias("cand_id"), F.col("centroid").alias("vector"))
        top = blocked_top_k(queries, cands, ["_all"], n)
        entry = F.struct("rank", F.col("cand_id").alias("code"), "score")
        gathered = top.groupBy("row_id").agg(F.array_sort(F.collect_list(entry)).alias("r"))
        return gathered.select("row_id", F.transform("r", lambda x: F.struct(x["code"].alias("code"), x["score"].alias("score"))).alias("ranked"))
    codes, matrix = small
    shared = df.sparkSession.sparkContext.broadcast((np.array(codes, dtype=object), matrix))
    width = min(top_k or len(codes), len(codes))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, m = shared.value
        for batch in batches:
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            v = flat.reshape(batch.num_rows, m.shape[1])
            sims = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)) @ m.T
            sims = np.round(sims, 12)
            order = np.argsort(-sims, axis=1, kind="stable")[:, :width]
            entries = pa.StructArray.from_arrays(
                [pa.array(names[order.ravel()], pa.string()), pa.array(np.take_along_axis(sims, order, axis=1).ravel())],
                names=["code", "score"],
            )
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.ListArray.from_arrays(offsets, entries)], names=["row_id", "ranked"])

    return df.select("row_id", "embedding").mapInArrow(score, f"row_id {row_type}, ranked array<struct<code:string,score:double>>")


def centroid_scores(df: DataFrame, centroids: DataFrame) -> DataFrame:
    """Similarity of every row to every code, long form."""
    return top_centroids(df, centroids).select("row_id", F.explode("ranked").alias("c")).select("row_id", "c.code", "c.score")


def nearest_examples(predicted: DataFrame, vectors: DataFrame, examples: DataFrame, k: int = 2) -> DataFrame:
    """The ``k`` most similar stored examples for each predicted code: ``(row_id, code, rank, example_id, score)``."""
    if k < 1:
        nothing = predicted.limit(0).select("code", "row_id", F.lit(None).cast("string").alias("example_id"))
        return nothing.withColumns({"score": F.lit(0.0), "rank": F.lit(0)})
    queries = predicted.select("row_id", "code").join(vectors.select("row_id", "embedding"), "row_id").select(
        "code", "row_id", F.col("embedding").alias("vector")
    )
    cands = examples.select("code", F.col("example_id").alias("cand_id"), F.col("embedding").alias("vector"))
    return blocked_top_k(queries, cands, ["code"], k).withColumnRenamed("cand_id", "example_id")


# ---- index jobs ------------------------------------------------------------------------------

INDEX_COLUMNS = ["row_id", "text", "code", "code_name", "parent_code", "parent_name"]


def build_index(long: DataFrame, codebook: DataFrame, encoder: Encoder | None = None, batch_size: int = 64, prefix: str = "") -> EmbeddingIndex:
    """Encodes the long table (if it has no ``embedding`` yet) and computes both sets of centroids."""
    require_columns(long, INDEX_COLUMNS)
    require_rows(long, "Cannot build an index from an empty table.")
    encoded = long if "embedding" in long.columns else encode(long, "text", encoder, batch_size, prefix)
    # A stable key from the data itself: row and code identify an example. Written once: both sets of centroids and the store read it.
    examples = materialize(encoded.withColumn("example_id", F.concat_ws("|", F.col("row_id").cast("string"), "code")), "examples")
    config = {"input_prefix": prefix, "embeddings_normalized": True}
    return EmbeddingIndex(examples, code_centroids(examples, codebook), parent_centroids(examples), codebook, config)


def check_index(examples: DataFrame, dim: int) -> DataFrame:
    """How many examples lack a vector of the right length."""
    bad = F.col("embedding").isNull() | (F.size("embedding") != dim)
    return examples.agg(F.count("*").alias("n_examples"), F.count_if(bad).alias("n_bad_embeddings"))


def classify_by_index(
    df: DataFrame, index: EmbeddingIndex, top_k: int = 5, threshold: float = 0.65, max_labels: int = 6,
    margin: float = 0.05, nearest_k: int = 2,
) -> DataFrame:
    """Prediction columns plus the nearest examples of each accepted code. ``df`` has ``row_id, embedding``."""
    # Written once: the predictions and the search for examples read it.
    ranked = materialize(top_centroids(df, index.code_centroids, top_k), "ranked")
    names = index.code_centroids.select("code", F.col("code_name").alias("name"), "parent_code", "parent_name")
    out = prediction_columns(ranked, names, threshold, max_labels, top_k, margin, INDEX_RULES)
    if nearest_k < 1:
        return out.withColumn("nearest_examples", F.lit(""))
    cut = accepted(F.col("ranked"), threshold, max_labels)
    kept = ranked.select("row_id", F.posexplode(cut).alias("pos", "c")).select("row_id", "pos", F.col("c.code").alias("code"))
    near = nearest_examples(kept, df, index.examples, nearest_k)
    texts = near.join(index.examples.select("example_id", "text"), "example_id")
    per_code = texts.groupBy("row_id", "code").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("found"))
    group = F.struct("pos", "code", F.transform("found", lambda x: x["text"]).alias("texts"))
    per_row = kept.join(per_code, ["row_id", "code"]).groupBy("row_id").agg(F.array_sort(F.collect_list(group)).alias("groups"))
    shown = per_row.select("row_id", format_nearest(F.col("groups")).alias("nearest_examples"))
    return out.join(shown, "row_id", "left").na.fill("", ["nearest_examples"])
