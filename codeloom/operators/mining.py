"""Training pairs and triplets for an external encoder trainer.

Each code yields a bounded number of pairs, whatever its size: pairs are numbered, numbers are
drawn, and only the drawn positions are looked up. No step lists all pairs of a group. Texts are
identified by digest until the end, so text bodies move only for the rows that were drawn.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clean_text
from ..settings import materialize
from .hashing import digits_for, hash_rank, stratified_draw


def text_digest(text: Column) -> Column:
    """Hash of the cleaned text; null for a blank one."""
    return F.md5(F.nullif(clean_text(text), F.lit("")))


def digest_table(long: DataFrame) -> DataFrame:
    """``(row_id, code, digest)`` of the non-blank texts, written once: every later step reads this.

    ``long`` may bring the ``digest`` of its texts, made before its rows were repeated for each code.
    """
    digest = F.col("digest") if "digest" in long.columns else text_digest(F.col("text"))
    rows = long.select("row_id", "code", digest.alias("digest"))
    return materialize(rows.where(F.col("digest").isNotNull()), "digests")


def text_occurrences(digests: DataFrame) -> DataFrame:
    """Distinct texts per code: ``(code, digest, first_row, responses)``."""
    return digests.groupBy("code", "digest").agg(
        F.min("row_id").alias("first_row"), F.count_distinct("row_id").alias("responses")
    )


@dataclass(frozen=True)
class MiningTables:
    """The two small tables all draws work on; share them between several draws on the same data."""

    digests: DataFrame
    occurrences: DataFrame


def mining_tables(long: DataFrame) -> MiningTables:
    digests = digest_table(long)
    return MiningTables(digests, materialize(text_occurrences(digests), "occurrences"))


def class_sizes(long: DataFrame, n: int | None = 20) -> DataFrame:
    """Distinct texts per code, largest first; the report shows the top ``n``."""
    sizes = long.groupBy("code").agg(F.count_distinct("text").alias("n_texts")).orderBy(F.desc("n_texts"), "code")
    return sizes if n is None else sizes.limit(n)


def _texts_of(rows: DataFrame, long: DataFrame, columns: list[str]) -> DataFrame:
    """Adds the cleaned texts of the rows that ``columns`` name. ``rows`` are distinct; each text is fetched once and joined once."""
    roles = F.array(*[F.struct(F.lit(c).alias("role"), F.col(c).alias("row_id")) for c in columns])
    asked = rows.select("*", F.explode(roles).alias("_r")).select(*rows.columns, "_r.role", "_r.row_id")
    ids = asked.select("row_id").distinct()
    bodies = long.join(ids, "row_id", "left_semi").groupBy("row_id").agg(F.first(clean_text(F.col("text"))).alias("body"))
    texts = [F.max(F.when(F.col("role") == c, F.col("body"))).alias(f"{c}_text") for c in columns]
    return asked.join(bodies, "row_id").groupBy(*rows.columns).agg(*texts)


def _sizes(occurrences: DataFrame, min_class_size: int) -> DataFrame:
    return occurrences.groupBy("code").agg(F.count("*").alias("n")).where(F.col("n") >= min_class_size)


def _drawn_pairs(occurrences: DataFrame, min_class_size: int, max_pairs: int, seed: int) -> DataFrame:
    """``(code, t, row_a, row_b)``: all pairs of distinct texts of a code, or ``max_pairs`` of them.

    With texts numbered 0..n-1 in hash order, pair number ``p`` joins text ``p % n`` with the text
    ``p div n + 1`` places further on, cyclically; p runs over [0, n*(n-1)/2) and meets every
    unordered pair exactly once.
    """
    if min_class_size < 2 or max_pairs < 1:
        raise ValueError("min_class_size must be at least 2 and max_pairs positive.")
    n, p = F.col("n"), F.col("p")
    drawn = stratified_draw(F.floor(n * (n - 1) / 2), F.lit(max_pairs), seed, F.lit("pair"), F.col("code"))
    draws = _sizes(occurrences, min_class_size).select("code", "n", F.posexplode_outer(drawn).alias("t", "p"))
    ends = F.array((p % n), (p % n + F.floor(p / n) + 1) % n)
    ends = draws.select("code", "t", F.explode_outer(ends).alias("rank"))
    numbered = hash_rank(occurrences, ["code"], "digest").select("code", "rank", "first_row")
    found = ends.join(numbered, ["code", "rank"])
    return found.groupBy("code", "t").agg(F.min("first_row").alias("row_a"), F.max("first_row").alias("row_b"))


def positive_pairs(
    long: DataFrame, min_class_size: int = 10, max_pairs: int = 5000, seed: int = 42, prepared: MiningTables | None = None
) -> DataFrame:
    """Pairs of distinct texts with the same code, earlier text first."""
    occurrences = (prepared or mining_tables(long)).occurrences
    pairs = _texts_of(_drawn_pairs(occurrences, min_class_size, max_pairs, seed), long, ["row_a", "row_b"])
    return pairs.select(
        "code", "row_a", "row_b", F.col("row_a_text").alias("text_a"), F.col("row_b_text").alias("text_b"),
        F.lit(1.0).alias("label"), F.lit("positive").alias("sample_type"),
    )


# ---- texts without a code --------------------------------------------------------------------


@dataclass(frozen=True)
class Complements:
    """For each code the texts it does not own, without a list of them.

    A code owns a text if all responses with that text carry it. All texts are numbered once, in the order of their digests. The k-th text
    that a code does not own is found by arithmetic on the numbers of those it owns, which are fewer than its occurrences.
    """

    texts: DataFrame  # digest, row, g: the number among all texts
    owned: DataFrame  # code, g, v: the number of texts before it that the code does not own
    sizes: DataFrame  # code, n_owned, n_candidates
    n_texts: int


def complements(tables: MiningTables, codes: DataFrame) -> Complements:
    """Complements of the texts of each code in ``codes`` (``code``)."""
    uses = tables.digests.groupBy("digest").agg(F.count_distinct("row_id").alias("uses"), F.min("row_id").alias("row"))
    uses = materialize(uses.withColumn("pool", F.lit("")), "texts")
    n_texts = uses.count()
    digits = digits_for(n_texts)
    texts = materialize(hash_rank(uses, ["pool"], "digest", "g", digits).drop("pool"), "numbered-texts")
    whole = tables.occurrences.join(codes.select("code").distinct(), "code", "left_semi").join(texts, "digest").where(F.col("responses") == F.col("uses"))
    ranked = hash_rank(whole.select("code", "digest", "g"), ["code"], "digest", "i", digits)
    owned = materialize(ranked.select("code", "g", (F.col("g") - F.col("i")).alias("v")), "owned")
    counted = owned.groupBy("code").agg(F.count("*").alias("n_owned"))
    sizes = codes.select("code").distinct().join(counted, "code", "left").na.fill(0, ["n_owned"])
    return Complements(texts, owned, sizes.withColumn("n_candidates", F.lit(n_texts) - F.col("n_owned")), n_texts)


def _count_up_to(values: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """``asked`` (``code, x``, ...) with ``below``: how many ``values`` (``code, value``) of the code are at most ``x``. Both lie in [0, n].

    The range of numbers is cut into buckets, so that a code of a third of all texts is counted in thousands of tasks.
    """
    width = max(1, -(-(n + 1) // 16 ** digits_for(n)))
    rest = [c for c in asked.columns if c not in ("code", "x")]
    both = values.select("code", F.col("value").alias("x"), F.lit(1).alias("_is_value"), *[F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in rest])
    both = both.unionByName(asked.withColumn("_is_value", F.lit(0))).withColumn("_bucket", F.floor(F.col("x") / width))
    counts = both.groupBy("code", "_bucket").agg(F.sum("_is_value").alias("_in"))
    earlier = W.partitionBy("code").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("code", "_bucket", F.coalesce(F.sum("_in").over(earlier), F.lit(0)).alias("_before"))
    inside = W.partitionBy("code", "_bucket").orderBy("x", F.desc("_is_value")).rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = both.join(counts, ["code", "_bucket"]).withColumn("below", F.col("_before") + F.sum("_is_value").over(inside))
    return counted.where(F.col("_is_value") == 0).select(*asked.columns, "below")


def candidates_at(found: Complements, asked: DataFrame) -> DataFrame:
    """``asked`` (``code, k``, ...) with the ``digest`` and ``row`` of the k-th text that the code does not own."""
    values = found.owned.select("code", F.col("v").alias("value"))
    counted = _count_up_to(values, asked.withColumnRenamed("k", "x"), found.n_texts)
    numbered = counted.withColumn("g", F.col("x") + F.col("below")).withColumnRenamed("x", "k")
    return numbered.join(found.texts.select("g", "digest", "row"), "g").select(*asked.columns, "digest", "row")


def candidate_positions(found: Complements, asked: DataFrame) -> DataFrame:
    """``asked`` (``code, g``, ...) with ``k``: the place of text number g among those that the code does not own. g must be one of them."""
    values = found.owned.select("code", F.col("g").alias("value"))
    counted = _count_up_to(values, asked.withColumnRenamed("g", "x"), found.n_texts)
    return counted.withColumn("k", F.col("x") - F.col("below")).withColumnRenamed("x", "g").drop("below")


def negative_candidates(long: DataFrame, min_class_size: int = 10, prepared: MiningTables | None = None) -> DataFrame:
    """``(code, k, row)``: every text of a response without the code, numbered in the order of digests, for each code of enough texts.

    The list has up to codes × texts rows; the draws below look up positions instead of reading it.
    """
    tables = prepared or mining_tables(long)
    found = complements(tables, _sizes(tables.occurrences, min_class_size))
    spans = found.sizes.where(F.col("n_candidates") > 0)
    asked = spans.select("code", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_candidates").cast("bigint") - 1)).alias("k"))
    return candidates_at(found, asked).select("code", "k", "row")


def contrastive_negatives(
    long: DataFrame, min_class_size: int = 10, max_pairs: int = 5000, ratio: float = 1.0, cap: int | None = None, seed: int = 42,
    prepared: MiningTables | None = None,
) -> DataFrame:
    """Pairs of a text with the code and a text without it, distinct and never the same text.

    Per code ``ceil(positives * ratio)`` pairs, at most ``cap`` and at most all there are. A text with the code is the partner of all
    candidates, but for itself where it is one (a text with and without the code): texts that the code owns come first and have
    one cell for each candidate, the others have one cell less. The cells are numbered, so every drawn number is a pair.
    """
    if ratio < 0 or (cap is not None and cap < 1):
        raise ValueError("ratio must be non-negative and cap positive.")
    tables = prepared or mining_tables(long)
    sizes = _sizes(tables.occurrences, min_class_size)
    found = complements(tables, sizes)
    positives = F.least(F.floor(F.col("n") * (F.col("n") - 1) / 2), F.lit(max_pairs))
    wanted = F.ceil(positives * F.lit(float(ratio))).cast("bigint")
    wanted = wanted if cap is None else F.least(wanted, F.lit(cap))
    m, v, p = F.col("n_owned"), F.col("n_candidates"), F.col("p")
    cells = m * v + (F.col("n") - m) * F.greatest(v - 1, F.lit(0))
    plan = sizes.join(found.sizes, "code").select("code", "n_owned", "n_candidates", stratified_draw(cells, wanted, seed, F.lit("cell"), F.col("code")).alias("p"))
    drawn = plan.select("code", "n_owned", "n_candidates", F.explode("p").alias("p")).withColumn("own", p < m * v)
    rest, width = p - m * v, v - 1
    drawn = drawn.select(
        "code", "own", F.when(F.col("own"), F.floor(p / v)).otherwise(F.floor(rest / width)).alias("i"),
        F.when(F.col("own"), p % v).otherwise(rest % width).alias("k"),
    )
    anchors = tables.occurrences.join(sizes.select("code"), "code", "left_semi").join(found.texts.select("digest", "g", "uses"), "digest")
    anchors = anchors.select("code", "digest", "g", F.col("first_row").alias("row_a"), (F.col("responses") == F.col("uses")).alias("own"))
    anchors = hash_rank(anchors, ["code", "own"], "digest", "i", digits_for(found.n_texts))
    pairs = materialize(drawn.join(anchors.select("code", "own", "i", "g", "row_a"), ["code", "own", "i"]), "drawn-cells")
    plain = pairs.where("own").select("code", "k", "row_a")
    # A text that is a candidate itself is left out of its own cells.
    shared = candidate_positions(found, pairs.where("NOT own").select("code", "g", F.col("k").alias("j"), "row_a"))
    shared = shared.select("code", (F.col("j") + (F.col("j") >= F.col("k")).cast("bigint")).alias("k"), "row_a")
    rows = candidates_at(found, plain.unionByName(shared)).select("code", "row_a", F.col("row").alias("row_b"))
    pairs = _texts_of(rows, long, ["row_a", "row_b"])
    return pairs.select(
        "code", "row_a", "row_b", F.col("row_a_text").alias("text_a"), F.col("row_b_text").alias("text_b"),
        F.lit(0.0).alias("label"), F.lit("negative").alias("sample_type"),
    )


def triplets(
    long: DataFrame, min_class_size: int = 10, max_triplets: int = 5000, seed: int = 42, prepared: MiningTables | None = None
) -> DataFrame:
    """(anchor, positive, negative) per drawn pair; codes without any negative give none.

    A code with as many pairs as candidates or fewer draws a candidate of its own for each pair; else the pairs take turns on all of them.
    """
    tables = prepared or mining_tables(long)
    pairs = materialize(_drawn_pairs(tables.occurrences, min_class_size, max_triplets, seed), "pairs")
    wanted = pairs.groupBy("code").agg(F.count("*").alias("wanted"))
    found = complements(tables, wanted)
    draws = stratified_draw(F.col("n_candidates"), F.col("wanted"), seed, F.lit("negative"), F.col("code"))
    drawn = wanted.join(found.sizes, "code").select("code", F.posexplode(draws).alias("turn", "k"))
    turns = wanted.join(found.sizes.where("n_candidates > 0"), "code").select("code", F.least("wanted", "n_candidates").alias("turns"))
    asked = pairs.join(turns, "code").withColumn("turn", (F.col("t") % F.col("turns")).cast("int")).join(drawn, ["code", "turn"])
    rows = candidates_at(found, asked.select("code", "k", "row_a", "row_b")).select("code", "row_a", "row_b", F.col("row").alias("row_n"))
    full = _texts_of(rows, long, ["row_a", "row_b", "row_n"])
    return full.select(
        "code", "row_a", "row_b", "row_n", F.col("row_a_text").alias("anchor"), F.col("row_b_text").alias("positive"),
        F.col("row_n_text").alias("negative"),
    )
