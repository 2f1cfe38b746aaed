"""Response × code pairs for the pair model, with sampled negatives and class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import bind
from ..functions.codes import class_of_sentiment
from ..settings import MAX_LITERAL_CODES, collect_bounded
from .hashing import hash_order

PAIR_CLASSES = 4


def literal_leaves(codebook: DataFrame) -> list:
    """Leaf rows of the codebook in codebook order, for use as a literal; its size is checked."""
    cols = ["order", "code", "name", "description", "parent_code", "parent_name"]
    rows = collect_bounded(codebook.where(~F.col("is_parent")).select(*cols), MAX_LITERAL_CODES, "The codebook")
    if not rows:
        raise ValueError("No code can be paired: every row of the codebook is a parent.")
    return sorted(rows, key=lambda r: (r["order"], r["code"]))


def _leaf_array(leaves: list) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(leaf["code"]).alias("code"),
                F.lit(leaf["parent_code"]).alias("parent_code"),
            )
            for i, leaf in enumerate(leaves)
        ]
    )


def _selected_leaves(leaves: Column, positives: Column, ratio: float | None, seed: int, row_id: Column) -> Column:
    """The leaves to pair a response with. Everything happens inside the row: no shuffle at all."""
    if ratio is None:
        return leaves
    wanted = F.ceil(F.lit(float(ratio)) * F.greatest(F.size(positives), F.lit(1))).cast("int")

    def in_hash_order(items: Column) -> Column:
        keyed = F.transform(items, lambda x: F.struct(hash_order(seed, row_id, x["code"]).alias("h"), x.alias("leaf")))
        return F.transform(F.array_sort(keyed), lambda x: x["leaf"])

    def draw(kept: Column, order: Column, parents: Column, target: Column) -> Column:
        related = F.filter(order, lambda x: F.array_contains(parents, x["parent_code"]))
        hard = F.slice(related, F.lit(1), F.ceil(target / 2).cast("int"))
        return bind(hard, lambda h: F.concat(kept, h, F.slice(F.array_except(order, h), F.lit(1), target - F.size(h))))

    is_positive = lambda x: F.array_contains(positives, x["code"])
    return bind(F.filter(leaves, is_positive), lambda kept: bind(
        in_hash_order(F.filter(leaves, lambda x: ~is_positive(x))), lambda order: bind(
            F.transform(kept, lambda x: x["parent_code"]), lambda parents: draw(
                kept, order, parents, F.least(wanted, F.size(order))))))


def build_pairs(
    responses: DataFrame, codebook: DataFrame, negative_ratio: float | None = None, seed: int = 42
) -> DataFrame:
    """One row per response and selected leaf: label 0 (absent) or 1 + sentiment.

    ``responses`` has ``row_id, text, answer, context, annotations``. With ``negative_ratio=None``
    every leaf is paired; otherwise ``ceil(ratio * max(positives, 1))`` negatives are drawn, half
    of them from the parents of the positives. The draw depends only on (seed, row_id, code).
    Selection works on codes alone; names and descriptions come from a size-checked literal.
    """
    if negative_ratio is not None and negative_ratio < 0:
        raise ValueError("The share of negatives cannot be below zero.")
    leaves = literal_leaves(codebook)
    labels = F.map_from_entries(F.transform("annotations", lambda a: F.struct(a["code"], a["sentiment"])))
    chosen = bind(
        F.transform("annotations", lambda a: a["code"]),
        lambda codes: _selected_leaves(_leaf_array(leaves), codes, negative_ratio, seed, F.col("row_id")),
    )
    # The outer form (a codebook is never empty) keeps the planner from adding a filter on the array,
    # which would evaluate the whole selection a second time.
    pairs = responses.select("row_id", "text", "answer", "context", labels.alias("_labels"), F.explode_outer(chosen).alias("leaf"))
    sentiment = F.try_element_at("_labels", F.col("leaf.code"))
    names = F.array(*[F.struct(F.lit(x["name"]).alias("name"), F.lit(x["description"]).alias("description")) for x in leaves])
    info = F.element_at(names, F.col("leaf.position") + 1)
    return pairs.select(
        "row_id", "text", "answer", "context",
        F.col("leaf.code").alias("code"),
        info["name"].alias("code_name"),
        info["description"].alias("code_description"),
        class_of_sentiment(sentiment).alias("label"),
        sentiment.alias("sentiment"),
        F.col("leaf.position").alias("code_position"),
    )


def full_pairs(responses: DataFrame, codebook: DataFrame) -> DataFrame:
    return build_pairs(responses, codebook, None)


def pair_distribution(pairs: DataFrame, splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """Pairs per split and class, zeros kept."""
    spark = pairs.sparkSession
    cells = spark.createDataFrame([(s, c) for s in splits for c in range(PAIR_CLASSES)], "split string, label int")
    counted = pairs.groupBy("split", "label").agg(F.count("*").alias("n_pairs"))
    return cells.join(counted, ["split", "label"], "left").na.fill(0, ["n_pairs"])


def class_weights(pairs: DataFrame, cap: float = 10.0) -> DataFrame:
    """``n / (4 * count)`` per class, 1 for a class without pairs, clipped to [0.25, cap]."""
    counts = pairs.agg(
        F.count("*").alias("n"), *[F.count_if(F.col("label") == c).alias(f"c{c}") for c in range(PAIR_CLASSES)]
    )
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"c{c}").alias("n_pairs")) for c in range(PAIR_CLASSES)]))
    raw = F.when(F.col("n_pairs") > 0, F.col("n") / (4.0 * F.col("n_pairs"))).otherwise(1.0)
    weight = F.least(F.greatest(raw, F.lit(0.25)), F.lit(float(cap)))
    return counts.select("n", rows.alias("r")).select("n", "r.*").select("label", "n_pairs", weight.alias("weight"))


def positive_weights(rows: DataFrame, classes: DataFrame, cap: float = 20.0) -> DataFrame:
    """Negatives per positive for each code, 1 without positives, clipped to [1, cap]."""
    total = rows.agg(F.count("*")).scalar()
    counted = rows.select(F.explode(F.array_distinct("codes")).alias("code")).groupBy("code").agg(F.count("*").alias("positives"))
    table = classes.select("code").join(counted, "code", "left").na.fill(0, ["positives"]).withColumn("n", total)
    raw = F.when(F.col("positives") > 0, (F.col("n") - F.col("positives")) / F.col("positives")).otherwise(1.0)
    return table.select("code", "positives", F.least(F.greatest(raw, F.lit(1.0)), F.lit(float(cap))).alias("weight"))


def balanced_weights(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Weights of the two sides of each one-vs-rest model: ``n / (2 * side)``."""
    total = rows.agg(F.count("*")).scalar()
    counted = rows.select(F.explode(F.array_distinct("codes")).alias("code")).groupBy("code").agg(F.count("*").alias("positives"))
    table = classes.select("code").join(counted, "code", "left").na.fill(0, ["positives"]).withColumn("n", total)
    negatives = F.col("n") - F.col("positives")

    def side(count: Column) -> Column:
        return F.when(count > 0, F.col("n") / (2.0 * count)).otherwise(1.0)

    return table.select("code", "positives", side(F.col("positives")).alias("positive_weight"), side(negatives).alias("negative_weight"))
