"""From scores to predictions: ranking, thresholds, confidence, review flags, names.

Long scores ``(row_id, code, score)`` are gathered once per row, which costs the only shuffle; a
row has at most one score per code of the codebook. Everything after that is array work in the row.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import SENTIMENT_NAMES, or_unknown, pair_text, sentiment_names
from ..functions.text import format_candidates, join_labels
from ..settings import MAX_LITERAL_CODES, UNKNOWN, collect_bounded
from .pairs import literal_leaves


#: Names of a codebook up to this size are a literal in the plan.
MAX_MAPPED_CODES = 500


@dataclass(frozen=True)
class DecodeRules:
    """What differs between the kinds of classifier."""

    lone_margin_is_one: bool = False  # margin of a single candidate: 1, or its own score
    accept_within_top_k: bool = False  # accept only among the shown candidates
    review_low_top: bool = False  # a best score below the threshold asks for review
    digits: int | None = None  # rounding of confidence and margin
    name_sep: str = ", "
    parent_names_by: str = "code"  # distinct parents by code, or by name


INDEX_RULES = DecodeRules(True, True, True, 4, ", ", "name")
LINEAR_RULES = DecodeRules(False, False, True, 4, ", ", "code")
ENCODER_RULES = DecodeRules(False, False, False, None, "; ", "code")
PAIR_RULES = DecodeRules(False, False, False, None, "; ", "code")


def check_decode_args(threshold: float, max_labels: int, top_k: int = 1, margin: float = 0.0) -> None:
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be in [0, 1].")
    if max_labels < 1:
        raise ValueError("max_labels must be positive.")
    if top_k < 1:
        raise ValueError("top_k must be positive.")
    if margin < 0:
        raise ValueError("margin must be non-negative.")


def ranked_array(score: Column, code: Column, *extra: Column) -> Column:
    """Aggregate: candidates of a row, best first, ties by code."""
    entry = F.struct((-score).alias("_down"), code.alias("code"), score.alias("score"), *extra)
    return F.array_sort(F.collect_list(entry))


def gather_scores(scores: DataFrame) -> DataFrame:
    """``(row_id, ranked)`` with ``ranked`` an array of ``(code, score)``, best first."""
    ranked = ranked_array(F.col("score"), F.col("code"))
    return scores.groupBy("row_id").agg(
        F.transform(ranked, lambda x: F.struct(x["code"].alias("code"), x["score"].alias("score"))).alias("ranked")
    )


def rank_arrays(scored: DataFrame, classes: list[str]) -> DataFrame:
    """As ``gather_scores`` from rows that have their scores as one array in the order of ``classes``: ranked in the row, nothing is shuffled.

    Other columns are kept.
    """
    codes = F.array(*[F.lit(c) for c in classes])
    entries = F.transform("scores", lambda s, i: F.struct((-s).alias("_down"), F.get(codes, i).alias("code"), s.alias("score")))
    ranked = F.transform(F.array_sort(entries), lambda x: F.struct(x["code"].alias("code"), x["score"].alias("score")))
    return scored.select(*[c for c in scored.columns if c != "scores"], ranked.alias("ranked"))


def rank_candidates(scores: DataFrame, top_k: int = 5) -> DataFrame:
    """The ``top_k`` best codes of each row, ranks from 1."""
    top = gather_scores(scores).select("row_id", F.posexplode(F.slice("ranked", 1, top_k)).alias("pos", "c"))
    return top.select("row_id", (F.col("pos") + 1).alias("rank"), "c.code", "c.score")


def accepted(ranked: Column, threshold: float, max_labels: int) -> Column:
    return F.slice(F.filter(ranked, lambda c: c["score"] >= F.lit(float(threshold))), 1, max_labels)


def decode(scores: DataFrame, threshold: float, max_labels: int = 6) -> DataFrame:
    """Accepted codes in long form: score at the threshold or above, at most ``max_labels`` best."""
    check_decode_args(threshold, max_labels)
    kept = gather_scores(scores).select("row_id", F.posexplode(accepted(F.col("ranked"), threshold, max_labels)).alias("pos", "c"))
    return kept.select("row_id", (F.col("pos") + 1).alias("rank"), "c.code", "c.score")


def densify(scores: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Full grid of rows × codes; a missing pair has P(absent) = 1.

    The class list is checked and turned into a literal, so the grid is an explode inside each row.
    """
    codes = sorted(r["code"] for r in collect_bounded(classes.select("code"), MAX_LITERAL_CODES, "The class list"))
    grid = rows.select("row_id", F.explode(F.array(*[F.lit(c) for c in codes])).alias("code"))
    absent = F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    return grid.join(scores, ["row_id", "code"], "left").withColumn("probs", F.coalesce("probs", absent))


def presence(probs: Column) -> Column:
    return F.lit(1.0) - F.element_at(probs, 1)


def best_sentiment(probs: Column) -> Column:
    """Sentiment 0, 1 or 2 with the largest probability, the first one on ties."""
    tail = F.slice(probs, 2, 3)
    return (F.array_position(tail, F.array_max(tail)) - 1).cast("int")


def gather_pair_scores(probs: DataFrame) -> DataFrame:
    """As ``gather_scores`` for the pair model: candidates carry their sentiment."""
    scored = probs.select("row_id", "code", presence(F.col("probs")).alias("score"), best_sentiment(F.col("probs")).alias("sentiment"))
    ranked = ranked_array(F.col("score"), F.col("code"), F.col("sentiment").alias("sentiment"))
    entry = lambda x: F.struct(x["code"].alias("code"), x["score"].alias("score"), x["sentiment"].alias("sentiment"))
    return scored.groupBy("row_id").agg(F.transform(ranked, entry).alias("ranked"))


def rank_pair_arrays(scored: DataFrame, codes: list[str]) -> DataFrame:
    """As ``gather_pair_scores`` from rows with the probabilities of all ``codes`` in one array: ranked in the row, nothing is shuffled."""
    names = F.array(*[F.lit(c) for c in codes])
    entries = F.transform("probs", lambda p, i: F.struct(
        (-presence(p)).alias("_down"), F.get(names, i).alias("code"), presence(p).alias("score"), best_sentiment(p).alias("sentiment")
    ))
    ranked = F.transform(F.array_sort(entries), lambda x: F.struct(x["code"].alias("code"), x["score"].alias("score"), x["sentiment"].alias("sentiment")))
    return scored.select(*[c for c in scored.columns if c != "probs"], ranked.alias("ranked"))


def decode_sentiment(probs: DataFrame, threshold: float, max_labels: int = 6) -> DataFrame:
    """Accepted codes with their sentiment, long form, from long probabilities or from rows with ``ranked``."""
    check_decode_args(threshold, max_labels)
    ranked = probs if "ranked" in probs.columns else gather_pair_scores(probs)
    kept = ranked.select(
        "row_id", F.posexplode(accepted(F.col("ranked"), threshold, max_labels)).alias("pos", "c")
    )
    return kept.select("row_id", (F.col("pos") + 1).alias("rank"), "c.code", "c.score", "c.sentiment")


def confidence_columns(ranked: Column, rules: DecodeRules) -> tuple[Column, Column]:
    """Best score, and its distance to the second best."""
    score = lambda i: F.try_element_at(ranked, F.lit(i))["score"]
    top = F.coalesce(score(1), F.lit(0.0))
    lone = F.lit(1.0) if rules.lone_margin_is_one else top
    return top, F.when(F.size(ranked) > 1, top - F.coalesce(score(2), F.lit(0.0))).otherwise(lone)


def first_distinct(items: Column, key: str) -> Column:
    """Items whose ``key`` is non-empty and new, in order."""
    kept = F.filter(items, lambda x: x[key] != "")
    keys = F.transform(kept, lambda x: x[key])
    return F.filter(kept, lambda x, i: F.array_position(keys, x[key]) == i + 1)


def parent_rollup(labels: Column, by: str = "code") -> tuple[Column, Column]:
    """Parent codes and parent names of predicted labels, in prediction order.

    With ``by='code'`` each distinct parent code brings its name; with ``by='name'`` the names are
    made distinct on their own.
    """
    parents = first_distinct(labels, "parent_code")
    codes = F.transform(parents, lambda x: x["parent_code"])
    names = parents if by == "code" else first_distinct(labels, "parent_name")
    return codes, F.transform(names, lambda x: x["parent_name"])


def name_accepted(decoded: DataFrame, codebook: DataFrame, carried: list[str]) -> DataFrame:
    """Adds ``labels``: the accepted codes with names and parents from the codebook.

    A codebook of at most ``MAX_MAPPED_CODES`` codes is a literal map, looked up in the row. With a larger one, for which that would be a long
    search, the accepted codes are joined by code and gathered by row.
    """
    rows = codebook.select("code", "name", "parent_code", "parent_name").limit(MAX_MAPPED_CODES + 1).collect()
    if len(rows) > MAX_MAPPED_CODES:
        return _join_names(decoded, codebook, carried)
    table = json.dumps({r["code"]: {k: r[k] for k in ("name", "parent_code", "parent_name")} for r in rows})
    names = F.from_json(F.lit(table), "map<string,struct<name:string,parent_code:string,parent_name:string>>")

    def label(item: Column, pos: Column) -> Column:
        found = F.try_element_at(names, item["code"])
        return F.struct(
            pos.alias("pos"), item["code"].alias("code"), F.coalesce(found["name"], item["code"]).alias("name"),
            F.coalesce(found["parent_code"], F.lit("")).alias("parent_code"), F.coalesce(found["parent_name"], F.lit("")).alias("parent_name"),
            item.alias("item"),
        )

    return decoded.select("row_id", *carried, F.transform("accepted", label).alias("labels"))


def _join_names(decoded: DataFrame, codebook: DataFrame, carried: list[str]) -> DataFrame:
    opened = decoded.select("row_id", *carried, F.posexplode_outer("accepted").alias("_pos", "_c")).select(
        "row_id", *carried, "_pos", F.col("_c.code").alias("code"), F.col("_c").alias("_item")
    )
    dims = codebook.select("code", F.col("name").alias("_name"), F.col("parent_code").alias("_parent"),
                           F.col("parent_name").alias("_pname"))
    label = F.struct(
        F.col("_pos").alias("pos"), F.col("code").alias("code"),
        F.coalesce("_name", "code").alias("name"),
        F.coalesce("_parent", F.lit("")).alias("parent_code"),
        F.coalesce("_pname", F.lit("")).alias("parent_name"),
        F.col("_item").alias("item"),
    )
    joined = opened.join(dims, "code", "left")
    firsts = [F.first(c).alias(c) for c in carried]
    return joined.groupBy("row_id").agg(
        *firsts, F.array_sort(F.collect_list(F.when(F.col("code").isNotNull(), label))).alias("labels")
    )


def prediction_columns(
    gathered: DataFrame,
    codebook: DataFrame,
    threshold: float,
    max_labels: int,
    top_k: int,
    margin: float,
    rules: DecodeRules,
    blank: Column | None = None,
    with_sentiments: bool = False,
) -> DataFrame:
    """The result columns shared by all classifiers, from ``(row_id, ranked)``.

    ``blank`` marks rows whose text is empty: they get no code and ask for review.
    """
    check_decode_args(threshold, max_labels, top_k, margin)
    ranked = F.col("ranked")
    pool = F.slice(ranked, 1, top_k) if rules.accept_within_top_k else ranked
    top, gap = confidence_columns(pool if rules.accept_within_top_k else ranked, rules)
    is_blank = blank if blank is not None else F.lit(False)
    kept = accepted(pool, threshold, max_labels)
    decoded = gathered.select(
        "row_id", F.slice(ranked, 1, top_k).alias("shown"), top.alias("top"), gap.alias("gap"), is_blank.alias("blank"),
        F.when(is_blank, F.slice(kept, 1, 0)).otherwise(kept).alias("accepted"),
    )
    named = name_accepted(decoded, codebook, ["shown", "top", "gap", "blank"])
    labels = F.col("labels")
    codes = F.transform(labels, lambda x: x["code"])
    parent_codes, parent_names = parent_rollup(labels, rules.parent_names_by)
    review = (F.size(labels) == 0) | (F.col("gap") < F.lit(float(margin))) | F.col("blank")
    if rules.review_low_top:
        review = review | (F.col("top") < F.lit(float(threshold)))
    rounded = (lambda c: F.round(c, rules.digits)) if rules.digits is not None else (lambda c: c)
    out = [
        "row_id",
        or_unknown(join_labels(codes, ", ")).alias("predicted_codes"),
        or_unknown(join_labels(F.transform(labels, lambda x: x["name"]), rules.name_sep)).alias("predicted_names"),
        join_labels(parent_codes, ", ").alias("predicted_parent_codes"),
        join_labels(parent_names, rules.name_sep).alias("predicted_parent_names"),
        rounded(F.col("top")).alias("confidence"),
        rounded(F.col("gap")).alias("margin"),
        format_candidates(F.col("shown"), sentiment_names() if with_sentiments else None).alias("top_candidates"),
        review.alias("needs_review"),
    ]
    if with_sentiments:
        items = F.transform(labels, lambda x: x["item"])
        out += sentiment_columns(items)
    return named.select(*out)


def sentiment_columns(items: Column) -> list[Column]:
    """The three sentiment columns of labels ``[(code, sentiment), …]``."""
    names = F.array(*[F.lit(n) for n in SENTIMENT_NAMES])
    named = lambda x: F.concat(x["code"], F.lit(":"), F.element_at(names, x["sentiment"] + 1))
    return [
        F.array_join(F.transform(items, lambda x: x["sentiment"].cast("string")), ", ").alias("predicted_sentiments"),
        or_unknown(F.array_join(F.transform(items, pair_text), ", ")).alias("predicted_code_sentiments"),
        F.array_join(F.transform(items, named), "; ").alias("predicted_sentiment_names"),
    ]


def prediction_report(rows: DataFrame, scores: DataFrame, threshold: float, max_labels: int = 6) -> DataFrame:
    """True and predicted codes in class order, top five candidates, and whether they agree.

    An unlabelled row has empty true codes and the prediction UNKNOWN, which counts as not correct.
    """
    check_decode_args(threshold, max_labels)
    ranked = F.col("ranked")
    chosen = F.array_sort(F.transform(accepted(ranked, threshold, max_labels), lambda c: c["code"]))
    classes = F.transform(ranked, lambda c: c["code"])
    true_codes = F.array_join(F.array_sort(F.array_intersect(F.col("codes"), classes)), ", ")
    joined = rows.select("row_id", "codes").join(gather_scores(scores), "row_id")
    table = joined.select(
        "row_id", true_codes.alias("true_codes"),
        F.coalesce(F.nullif(F.array_join(chosen, ", "), F.lit("")), F.lit(UNKNOWN)).alias("predicted_codes"),
        format_candidates(F.slice(ranked, 1, 5)).alias("top_candidates"),
    )
    return table.withColumn("correct", F.col("true_codes") == F.col("predicted_codes"))


def pair_prediction_report(
    rows: DataFrame, scored: DataFrame, codebook: DataFrame, threshold: float, max_labels: int = 6
) -> DataFrame:
    """True and predicted code:sentiment pairs in the order of the codebook, top five candidates, and whether every code has its class.

    ``rows`` has ``row_id, answer, context, annotations`` (at most one sentiment of a code); ``scored`` the probabilities of all leaf codes in one array
    (``scorers.pair_arrays``). Pairs of other codes are left out.
    """
    check_decode_args(threshold, max_labels)
    leaves = literal_leaves(codebook)
    codes = F.array(*[F.lit(leaf["code"]) for leaf in leaves])
    names = F.array(*[F.lit(leaf["name"]) for leaf in leaves])
    place = lambda p: F.array_position(codes, p["code"])

    def in_order(pairs: Column) -> Column:
        known = F.filter(F.transform(pairs, lambda p: F.struct(place(p).alias("at"), p["code"].alias("code"), p["sentiment"].alias("sentiment"))), lambda p: p["at"] > 0)
        return F.array_sort(F.array_distinct(known))

    ranked = rank_pair_arrays(scored.select("row_id", "probs"), [leaf["code"] for leaf in leaves])
    joined = rows.select("row_id", "answer", "context", "annotations").join(ranked, "row_id")
    chosen = joined.select(
        "row_id", "answer", "context", in_order(F.col("annotations")).alias("gold"), in_order(accepted(F.col("ranked"), threshold, max_labels)).alias("pred"),
        F.slice("ranked", 1, 5).alias("shown"),
    )
    text = lambda pairs: or_unknown(F.array_join(F.transform(pairs, pair_text), ", "))
    digits = F.create_map(*[x for n in range(len(SENTIMENT_NAMES)) for x in (F.lit(n), F.lit(str(n)))])
    return chosen.select(
        "row_id", "answer", "context", text(F.col("gold")).alias("true_code_sentiments"), text(F.col("pred")).alias("predicted_code_sentiments"),
        format_candidates(F.col("shown"), digits).alias("top_candidates"), (F.col("gold") == F.col("pred")).alias("correct"),
        F.array_join(F.transform("pred", lambda p: F.get(names, (p["at"] - 1).cast("int"))), "; ").alias("predicted_names"),
    )
