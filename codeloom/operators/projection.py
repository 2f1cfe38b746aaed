"""Two-dimensional projections of vectors, as tables for a plot."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot
from .hashing import hash_cutoffs, hash_order
from .index import EmbeddingIndex, single_label_centroids
from .responses import single_label


def sample_exact(df: DataFrame, n: int | None, seed: int = 42, key: str = "row_id") -> DataFrame:
    """Exactly ``n`` rows, or all where ``n`` is empty, not positive or not smaller than the table.

    One cutoff hash decides, so the rows are neither sorted nor gathered.
    """
    if n is None or n <= 0:
        return df
    order = hash_order(seed, F.col(key))
    quota = df.sparkSession.createDataFrame([("", n)], "_group string, quota_kept bigint")
    cut = hash_cutoffs(df.select(F.lit("").alias("_group"), order.alias("_order")), ["_group"], "_order", quota)
    limit = cut.select("cut_kept").scalar()
    return df.where(F.coalesce(order <= limit, F.lit(True)))


def _covariance_times(vectors: DataFrame, mean: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Covariance of the vectors times the columns of ``basis``: every task adds up its rows, the sums are added by coordinate."""
    shared = vectors.sparkSession.sparkContext.broadcast((mean, basis))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, columns = shared.value
        total = np.zeros(columns.shape)
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(centre)) - centre
            total += x.T @ (x @ columns)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "sums"])

    width = basis.shape[1]
    parts = vectors.mapInArrow(run, "i bigint, sums array<double>")
    rows = parts.groupBy("i").agg(F.array(*[F.sum(F.col("sums")[j]) for j in range(width)]).alias("sums")).collect()
    out = np.zeros(basis.shape)
    for row in rows:
        out[row["i"]] = row["sums"]
    return out


def principal_axes(df: DataFrame, vector: str = "embedding", k: int = 2, block: int = 8, tolerance: float = 1e-9, max_passes: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the ``k`` principal axes (columns) of the vectors; the largest loading of an axis is positive.

    The space that the covariance makes of a few starting vectors is built up, ``block`` directions in a pass over the rows, until the
    axes in it are axes of the covariance. The driver holds directions, of which there are at most eight blocks at a time, and no matrix
    of all pairs of coordinates.
    """
    vectors = df.select(F.col(vector).cast("array<double>").alias("v"))
    if vectors.limit(2).count() < 2:
        raise ValueError("At least two vectors are required for a projection.")
    mean = np.array(vectors.select(array_to_vector("v").alias("v")).agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("m")).first()["m"])
    d = len(mean)
    width = min(d, max(block, k))
    new = np.linalg.qr(np.random.default_rng(0).normal(size=(d, width)))[0]
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    axes = new[:, :k]
    for _ in range(max_passes):
        made = _covariance_times(vectors, mean, new)
        basis, image = np.hstack([basis, new]), np.hstack([image, made])
        values, inner = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        order = np.argsort(-values)
        values, inner = values[order], inner[:, order]
        axes = basis @ inner[:, :k]
        rest = image @ inner[:, :k] - axes * values[:k]
        if basis.shape[1] >= d or np.linalg.norm(rest) <= tolerance * max(values[0], 1e-300):
            break
        # What the covariance adds to the space, twice freed of what is in it already.
        made = made - basis @ (basis.T @ made)
        new, sizes = np.linalg.qr(made - basis @ (basis.T @ made))
        new = new[:, np.abs(np.diag(sizes)) > 1e-12 * max(values[0], 1e-300)][:, : d - basis.shape[1]]
        if basis.shape[1] >= 8 * width:
            # Go on from the best directions found.
            basis, image = basis @ inner[:, : 2 * width], image @ inner[:, : 2 * width]
        if not new.shape[1]:
            break
    axes = np.hstack([axes, np.zeros((d, k - axes.shape[1]))]) if axes.shape[1] < k else axes
    return mean, axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(k)])


def project_pca(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Adds ``x, y``: two principal components of the centred vectors.

    The model is two axes and a mean, so the projection itself is arithmetic in the row.
    """
    mean, axes = principal_axes(df, vector)

    def component(i: int) -> Column:
        axis = F.array(*[F.lit(float(a)) for a in axes[:, i]])
        return dot(F.col(vector), axis) - F.lit(float(mean @ axes[:, i]))

    return df.withColumns({"x": component(0), "y": component(1)})


def minmax_scale(df: DataFrame, col: str, low: float, high: float, out: str | None = None) -> DataFrame:
    """Linear map of the column to [low, high] (which may be reversed); a constant column gives the midpoint."""
    value = F.col(col).cast("double")
    edges = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    scaled = F.lit(float(low)) + (value - edges["lo"]) * F.lit(float(high - low)) / (edges["hi"] - edges["lo"])
    middle = F.lit((low + high) / 2.0)
    return df.withColumn(out or col, F.when(edges["hi"] == edges["lo"], middle).otherwise(scaled))


def centroid_text(point_type: Column, code: Column, name: Column, n_examples: Column) -> Column:
    return F.concat(point_type, F.lit(": "), code, F.lit(" "), name, F.lit("; n_examples="), n_examples.cast("string"))


def centroid_points(centroids: DataFrame, level: str, single_label: bool = False) -> DataFrame:
    """Centroids as points: same columns as example points, with a display text and a larger radius."""
    point_type = ("subcategory_centroid" if level == "code" else "parent_centroid") + ("_single_label" if single_label else "")
    code, name = ("code", "code_name") if level == "code" else ("parent_code", "parent_name")
    shown = centroid_text(F.lit(point_type), F.col(code), F.col(name), F.col("n_examples"))
    return centroids.select(
        F.col(code).alias("code"), F.col(name).alias("code_name"), "parent_code", "parent_name", "n_examples",
        F.lit(point_type).alias("point_type"), F.lit(7).alias("point_radius"), shown.alias("text"),
        F.col("centroid").alias("embedding"),
    )


def projection_table(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """``x, y`` first, then the metadata, without the vectors."""
    projected = project_pca(df, vector)
    return projected.select("x", "y", *[c for c in df.columns if c != vector])


def project_index(index: EmbeddingIndex, target: str = "examples", single_label_only: bool = False, sample_size: int | None = 5000, seed: int = 42) -> DataFrame:
    """The projection of an index: its examples (all or a sample of rows), the centroids of its codes, or those of its parents.

    ``single_label_only`` takes examples of rows with one code, and centroids of such examples.
    """
    if target == "examples":
        examples = single_label(index.examples) if single_label_only else index.examples
        points = examples.withColumns({"point_type": F.lit("example"), "point_radius": F.lit(4)})
        return projection_table(sample_exact(points, sample_size, seed, "example_id"))
    if target not in ("codes", "parents"):
        raise ValueError("target must be one of: examples, codes, parents.")
    level = "code" if target == "codes" else "parent"
    if single_label_only:
        centroids = single_label_centroids(index.examples, level)
    else:
        centroids = index.code_centroids if level == "code" else index.parent_centroids
    return projection_table(centroid_points(centroids, level, single_label_only))
