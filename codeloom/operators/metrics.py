"""Multi-label, joint code-and-sentiment and ranking metrics.

Evaluated rows carry their gold and predicted labels as arrays. One pass explodes, per row, one
event for the row itself and one per label that is gold or predicted; events are combined before
the shuffle, which then moves one row per label and task. Overall metrics are arithmetic on that
small table. Zero divisions count as 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import pair_text, parse_annotations, parse_code_sentiments, split_codes
from ..settings import MAX_LITERAL_CODES, collect_bounded, materialize
from .decode import accepted, check_decode_args, gather_pair_scores, gather_scores
from .numbering import nth_largest

THRESHOLDS = [round(0.10 + 0.05 * i, 2) for i in range(17)]


def class_list(classes: DataFrame | Sequence[str]) -> list[str]:
    """Sorted distinct codes as a literal list, size-checked."""
    if isinstance(classes, DataFrame):
        rows = collect_bounded(classes.select("code").distinct(), MAX_LITERAL_CODES, "The class list")
        classes = [r["code"] for r in rows]
    return sorted(set(classes))


def _literal_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def ratio(part: Column, whole: Column, empty: float | None = 0.0) -> Column:
    return F.when(whole != 0, part / whole).otherwise(F.lit(empty).cast("double"))


def known_only(labels: Column, classes: Sequence[str]) -> Column:
    return F.array_intersect(labels, _literal_array(classes))


def evaluation_mask(
    df: DataFrame, gold: Column, pred: Column, classes: Sequence[str], keep: bool = False
) -> DataFrame:
    """``df`` with arrays ``gold`` and ``pred`` limited to known codes; rows without gold leave unless kept."""
    marked = df.withColumn("gold", known_only(gold, classes)).withColumn("pred", known_only(pred, classes))
    return marked if keep else marked.where(F.size("gold") > 0)


def row_accounting(df: DataFrame) -> DataFrame:
    """Input rows, evaluated rows and rows without a known gold code; ``df`` as from the mask with ``keep``."""
    return df.agg(
        F.count("*").alias("input_rows"),
        F.count_if(F.size("gold") > 0).alias("evaluated_rows"),
        F.count_if(F.size("gold") == 0).alias("rows_without_known_gold_codes"),
    )


def label_ranking_precision(ranked: Column, gold: Column, n_classes: int) -> Column:
    """Per row: for each gold label, the share of gold among labels scored at least as high; averaged.

    Ties take the worst rank; a row with no gold label, or with all of them, counts 1.
    """
    true = F.filter(ranked, lambda c: F.array_contains(gold, c["code"]))

    def share(label: Column) -> Column:
        above = lambda items: F.size(F.filter(items, lambda c: c["score"] >= label["score"]))
        return above(true) / above(ranked)

    total = F.aggregate(F.transform(true, share), F.lit(0.0), lambda acc, x: acc + x)
    trivial = (F.size(gold) == 0) | (F.size(gold) == n_classes)
    return F.when(trivial, 1.0).otherwise(total / F.size(true))


_COUNTS = ("tp", "g", "p", "rows", "exact", "unknown", "single", "single_hit", "lrap")


def _one_if(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0).cast("bigint")


def _event_array(gold: Column, pred: Column, top: Column, lrap: Column | None, more: Callable[[Column], dict[str, Column]] | None = None) -> Column:
    """One event for the row (label null) and one for each label that is gold or predicted; ``more`` adds counts to the latter."""
    both = F.array_intersect(gold, pred)
    single = F.size(gold) == 1
    zero = F.lit(0).cast("bigint")
    nothing = F.lit(0.0)
    extra = list(more(F.lit("")) if more else {})

    def event(label: Column, tp: Column, g: Column, p: Column, row: dict[str, Column], own: dict[str, Column]) -> Column:
        names = ("rows", "exact", "unknown", "single", "single_hit")
        return F.struct(
            label.alias("label"), tp.alias("tp"), g.alias("g"), p.alias("p"),
            *[row.get(n, zero).alias(n) for n in names], row.get("lrap", nothing).alias("lrap"), *[own.get(n, zero).alias(n) for n in extra],
        )

    per_row = event(F.lit(None).cast("string"), zero, zero, zero, {
        "rows": F.lit(1).cast("bigint"),
        "exact": _one_if((F.size(gold) == F.size(pred)) & (F.size(both) == F.size(gold))),
        "unknown": _one_if(F.size(pred) == 0),
        "single": _one_if(single),
        "single_hit": _one_if(single & (F.coalesce(top, F.lit("")) == F.try_element_at(gold, F.lit(1)))),
        "lrap": lrap if lrap is not None else nothing,
    }, {})
    per_label = F.transform(F.array_union(gold, pred), lambda x: event(
        x, _one_if(F.array_contains(both, x)), _one_if(F.array_contains(gold, x)), _one_if(F.array_contains(pred, x)), {}, more(x) if more else {}
    ))
    return F.concat(F.array(per_row), per_label)


def label_cells(rows: DataFrame, top: Column | None = None, lrap: Column | None = None) -> DataFrame:
    """One row per label with tp, gold and predicted counts, and one (label null) with the row sums."""
    first = top if top is not None else F.try_element_at("pred", F.lit(1))
    events = rows.select(F.explode_outer(_event_array(F.col("gold"), F.col("pred"), first, lrap)).alias("e")).select("e.*")
    return events.groupBy("label").agg(*[F.sum(n).alias(n) for n in _COUNTS])


def _sums(prefix: str = "", where: Column | None = None) -> list[Column]:
    """The counts of label cells, of those ``where`` holds, and the sum of F1 over the labels."""
    chosen = where if where is not None else F.lit(True)
    f1 = ratio(2.0 * F.col("tp"), F.col("g") + F.col("p"))
    counts = [F.coalesce(F.sum(F.when(chosen, F.col(n))), F.lit(0)).alias(prefix + n) for n in _COUNTS]
    return [*counts, F.coalesce(F.sum(F.when(chosen & F.col("label").isNotNull(), f1)), F.lit(0.0)).alias(f"{prefix}f1_sum")]


def _figures(n_classes: int, prefix: str = "") -> dict[str, Column]:
    """Metrics from the sums."""
    c = lambda n: F.col(prefix + n)
    wrong = c("g") + c("p") - 2 * c("tp")
    return {
        "n_rows": c("rows"),
        "micro_precision": ratio(c("tp"), c("p")),
        "micro_recall": ratio(c("tp"), c("g")),
        "micro_f1": ratio(2.0 * c("tp"), c("g") + c("p")),
        "macro_f1": c("f1_sum") / F.lit(float(n_classes)),
        "subset_accuracy": ratio(c("exact"), c("rows")),
        "hamming_loss": ratio(wrong, c("rows") * n_classes),
        "single_label_top1_accuracy": ratio(c("single_hit"), c("single"), None),
        "unknown_prediction_rate": ratio(c("unknown"), c("rows")),
        "lrap": ratio(c("lrap"), c("rows")),
    }


def _overall(cells: DataFrame, n_classes: int, ranked: bool) -> DataFrame:
    figures = _figures(n_classes)
    return cells.agg(*_sums()).select(*[c.alias(n) for n, c in figures.items() if ranked or n != "lrap"])


def overall_metrics(rows: DataFrame, classes: DataFrame | Sequence[str]) -> DataFrame:
    """One row of metrics from ``gold`` and ``pred`` arrays; the top prediction is the first of ``pred``."""
    return _overall(label_cells(rows), len(class_list(classes)), ranked=False)


def score_metrics(rows: DataFrame, classes: DataFrame | Sequence[str], threshold: float, max_labels: int = 6) -> DataFrame:
    """As ``overall_metrics`` from ``gold`` and ``ranked`` scores, with LRAP; top-1 is the best score."""
    names = class_list(classes)
    decoded = decoded_rows(rows, threshold, max_labels)
    top = F.try_element_at("ranked", F.lit(1))["code"]
    cells = label_cells(decoded, top, label_ranking_precision(F.col("ranked"), F.col("gold"), len(names)))
    return _overall(cells, len(names), ranked=True).withColumn("threshold", F.lit(float(threshold)))


def decoded_rows(rows: DataFrame, threshold: float, max_labels: int) -> DataFrame:
    check_decode_args(threshold, max_labels)
    return rows.withColumn("pred", F.transform(accepted(F.col("ranked"), threshold, max_labels), lambda c: c["code"]))


def scored_rows(gold: DataFrame, scores: DataFrame) -> DataFrame:
    """``(row_id, gold, ranked)`` from gold arrays and long scores."""
    return gold.select("row_id", "gold").join(gather_scores(scores), "row_id")


def per_code_report(rows: DataFrame, classes: DataFrame | Sequence[str]) -> DataFrame:
    """Support, precision, recall and F1 for every known code, largest support first."""
    names = class_list(classes)
    spark = rows.sparkSession
    counted = label_cells(rows).where(F.col("label").isNotNull()).select(F.col("label").alias("code"), "tp", "g", "p")
    table = spark.createDataFrame([(c,) for c in names], "code string").join(counted, "code", "left").na.fill(0)
    return table.select(
        "code", F.col("g").alias("support"),
        ratio(F.col("tp"), F.col("p")).alias("precision"),
        ratio(F.col("tp"), F.col("g")).alias("recall"),
        ratio(2.0 * F.col("tp"), F.col("g") + F.col("p")).alias("f1"),
    ).orderBy(F.desc("support"), "code")


def error_rows(rows: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Rows whose predicted set is not the gold set."""
    normal = lambda c: F.array_sort(F.array_distinct(F.col(c)))
    return rows.where(normal(gold) != normal(pred))


# ---- code and sentiment together -------------------------------------------------------------


def _codes_of(pairs: Column) -> Column:
    return F.array_distinct(F.transform(pairs, lambda p: p["code"]))


def _pair_labels(pairs: Column) -> Column:
    return F.transform(pairs, pair_text)


def presence_rows(rows: DataFrame) -> DataFrame:
    """``gold_pairs``/``pred_pairs`` arrays of (code, sentiment) reduced to code arrays."""
    return rows.withColumn("gold", _codes_of(F.col("gold_pairs"))).withColumn("pred", _codes_of(F.col("pred_pairs")))


def joint_rows(rows: DataFrame) -> DataFrame:
    return rows.withColumn("gold", _pair_labels(F.col("gold_pairs"))).withColumn("pred", _pair_labels(F.col("pred_pairs")))


def joint_classes(classes: Sequence[str]) -> list[str]:
    return [f"{c}:{s}" for c in classes for s in (0, 1, 2)]


def joint_metrics(rows: DataFrame, classes: DataFrame | Sequence[str]) -> DataFrame:
    """Micro and macro metrics over (code, sentiment) cells; the macro mean runs over all 3 × codes cells."""
    names = joint_classes(class_list(classes))
    table = overall_metrics(joint_rows(rows), names)
    wanted = {
        "micro_precision": "joint_micro_precision", "micro_recall": "joint_micro_recall", "micro_f1": "joint_micro_f1",
        "macro_f1": "joint_macro_f1", "subset_accuracy": "joint_subset_accuracy",
    }
    return table.select("n_rows", *[F.col(k).alias(v) for k, v in wanted.items()])


def _sentiment_counts() -> dict[str, Column]:
    gold, pred = F.col("gold_pairs"), F.col("pred_pairs")
    gold_codes, pred_codes = _codes_of(gold), _codes_of(pred)
    return {
        "correct": F.size(F.array_intersect(gold, pred)),
        "gold_pairs": F.size(F.array_distinct(gold)),
        "detected_pairs": F.size(F.filter(F.array_distinct(gold), lambda p: F.array_contains(pred_codes, p["code"]))),
        "gold_codes": F.size(gold_codes),
        "detected_codes": F.size(F.array_intersect(gold_codes, pred_codes)),
        "touched_codes": F.size(F.array_union(gold_codes, pred_codes)),
    }


def sentiment_accuracy(rows: DataFrame, classes: DataFrame | Sequence[str], single: bool) -> DataFrame:
    """Sentiment accuracy on gold pairs and on gold pairs whose code was found (null without any).

    ``single``: one sentiment per code, which adds the accuracy over all row × code cells;
    otherwise a code may carry several sentiments, which adds the pair counts.
    """
    sums = rows.select(*[c.alias(n) for n, c in _sentiment_counts().items()]).agg(
        F.count("*").alias("rows"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in _sentiment_counts()]
    )
    out = [
        ratio(F.col("correct"), F.col("gold_pairs"), None).alias("gold_code_sentiment_accuracy"),
        ratio(F.col("correct"), F.col("detected_pairs"), None).alias("detected_gold_sentiment_accuracy"),
        F.col("gold_codes").alias("gold_codes"),
        F.col("detected_codes").alias("detected_gold_codes"),
    ]
    if single:
        cells = F.col("rows") * len(class_list(classes))
        out.append(ratio(cells - F.col("touched_codes") + F.col("correct"), cells).alias("joint_pair_accuracy"))
    else:
        out += [F.col("gold_pairs").alias("gold_code_sentiment_pairs"), F.col("detected_pairs").alias("gold_pairs_with_detected_code")]
    return sums.select(*out)


def sentiment_by_code(rows: DataFrame, classes: DataFrame | Sequence[str]) -> DataFrame:
    """Both sentiment accuracies per code; null where a code has no gold (or no found) pair."""
    pred = F.col("pred_pairs")
    opened = rows.select(F.explode(F.transform(
        F.array_distinct("gold_pairs"),
        lambda p: F.struct(
            p["code"].alias("code"), F.array_contains(pred, p).cast("int").alias("hit"),
            F.array_contains(_codes_of(pred), p["code"]).cast("int").alias("found"),
        ),
    )).alias("x")).select("x.*")
    counted = opened.groupBy("code").agg(
        F.count("*").alias("pairs"), F.sum("hit").alias("hits"), F.sum("found").alias("found")
    )
    base = rows.sparkSession.createDataFrame([(c,) for c in class_list(classes)], "code string")
    return base.join(counted, "code", "left").na.fill(0).select(
        "code",
        ratio(F.col("hits"), F.col("pairs"), None).alias("gold_code_sentiment_accuracy"),
        ratio(F.col("hits"), F.col("found"), None).alias("detected_gold_sentiment_accuracy"),
    )


def joint_report(rows: DataFrame, classes: DataFrame | Sequence[str]) -> DataFrame:
    report = per_code_report(presence_rows(rows), classes)
    return report.join(sentiment_by_code(rows, classes), "code").orderBy(F.desc("support"), "code")


def matched_pairs(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Labels that are both gold and predicted, long form."""
    return gold.join(pred, ["row_id", "code", "sentiment"], "left_semi")


def gold_targets(df: DataFrame, codes: Column, sentiments: Column | None, classes: Sequence[str]) -> DataFrame:
    """Gold of the pair model: ``valid`` is false for conflicting rows; blank gold is all-absent and stays.

    ``status`` shows other faults and codes outside the class list, which callers treat as errors.
    """
    parsed = df.withColumn("_p", parse_annotations(codes, sentiments))
    pairs = F.col("_p.annotations")
    foreign = F.exists(pairs, lambda p: ~F.array_contains(_literal_array(classes), p["code"]))
    status = F.when((F.col("_p.status") == "ok") & foreign, "unknown_code").otherwise(F.col("_p.status"))
    marked = parsed.withColumns({"gold_pairs": pairs, "status": status})
    return marked.withColumn("valid", F.col("status") != "conflict").drop("_p")


def pair_confusion(pairs: DataFrame) -> DataFrame:
    """Counts of (label, predicted class): at most 16 rows. The first of equal probabilities wins."""
    predicted = (F.array_position("probs", F.array_max("probs")) - 1).cast("int")
    return pairs.select(F.col("label").cast("int").alias("label"), predicted.alias("predicted")).groupBy("label", "predicted").agg(
        F.count("*").alias("n")
    )


def pair_class_report(confusion: DataFrame) -> DataFrame:
    """Support, precision, recall, F1 of the four classes."""
    names = ("absent", "neutral", "positive", "negative")
    events = F.array(
        F.struct(F.col("label").alias("model_class"), F.col("n").alias("g"), F.lit(0).cast("bigint").alias("p")),
        F.struct(F.col("predicted").alias("model_class"), F.lit(0).cast("bigint").alias("g"), F.col("n").alias("p")),
    )
    tp = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)
    opened = confusion.select(tp.alias("hit"), F.posexplode(events).alias("side", "e"))
    counted = opened.groupBy("e.model_class").agg(
        F.sum(F.when(F.col("side") == 0, F.col("hit")).otherwise(0)).alias("tp"), F.sum("e.g").alias("g"), F.sum("e.p").alias("p")
    )
    base = confusion.sparkSession.createDataFrame(list(enumerate(names)), "model_class int, class_name string")
    return base.join(counted, "model_class", "left").na.fill(0).select(
        "model_class", "class_name", F.col("g").alias("support"), F.col("p").alias("predicted"),
        ratio(F.col("tp"), F.col("p")).alias("precision"), ratio(F.col("tp"), F.col("g")).alias("recall"),
        ratio(2.0 * F.col("tp"), F.col("g") + F.col("p")).alias("f1"),
    )


def pair_metrics(pairs: DataFrame) -> DataFrame:
    """Metrics of the 4-class pair model, one row, from ``label`` and ``probs``.

    Macro and weighted F1 run over the classes that occur in gold or prediction.
    """
    return pair_metrics_of(pair_confusion(pairs))


def pair_metrics_of(confusion: DataFrame) -> DataFrame:
    report = pair_class_report(confusion).where(F.col("support") + F.col("predicted") > 0)
    by_class = report.agg(F.struct(
        F.avg("f1").alias("macro"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted")
    )).scalar()
    n, label, pred = F.col("n"), F.col("label"), F.col("predicted")
    count = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    base = confusion.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("n_pairs"), count(label == pred).alias("hit"),
        count((label > 0) & (pred > 0)).alias("tp"), count(label > 0).alias("g"), count(pred > 0).alias("p"),
        count((label > 0) & (label == pred)).alias("sentiment_hit"),
    )
    return base.select(
        "n_pairs", ratio(F.col("hit"), F.col("n_pairs")).alias("accuracy"),
        by_class["macro"].alias("macro_f1"), by_class["weighted"].alias("weighted_f1"),
        ratio(F.col("tp"), F.col("p")).alias("presence_precision"), ratio(F.col("tp"), F.col("g")).alias("presence_recall"),
        ratio(2.0 * F.col("tp"), F.col("g") + F.col("p")).alias("presence_f1"),
        ratio(F.col("sentiment_hit"), F.col("g"), None).alias("sentiment_accuracy_on_gold_pairs"),
    )


# ---- threshold search ------------------------------------------------------------------------


def _threshold_cells(rows: DataFrame, max_labels: int, paired: bool) -> DataFrame:
    """Counts by (code, level, gold class, predicted class).

    ``level`` is the number of thresholds at or below the score, 0 for ranks beyond ``max_labels``.
    A code is predicted at threshold number j exactly when its level is above j, so one pass over
    the rows serves all 17 thresholds.
    """
    limits = F.array(*[F.lit(t) for t in THRESHOLDS])

    def cell(c: Column, i: Column) -> Column:
        level = F.when(i < max_labels, F.size(F.filter(limits, lambda t: t <= c["score"]))).otherwise(0)
        if paired:
            gold = F.coalesce(F.try_element_at("gold_map", c["code"]) + 1, F.lit(0))
            pred = c["sentiment"] + 1
        else:
            gold, pred = F.array_contains("gold", c["code"]).cast("int"), F.lit(1)
        return F.struct(c["code"].alias("code"), level.cast("int").alias("level"), gold.cast("int").alias("gold"), pred.cast("int").alias("pred"))

    opened = rows.select(F.explode(F.transform("ranked", cell)).alias("c")).select("c.*")
    return opened.where((F.col("level") > 0) | (F.col("gold") > 0)).groupBy("code", "level", "gold", "pred").agg(F.count("*").alias("n"))


def _f1_by_threshold(cells: DataFrame, n_cells: int, joint: bool, prefix: str) -> DataFrame:
    steps = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(t).alias("threshold")) for j, t in enumerate(THRESHOLDS)])
    spread = cells.select("*", F.explode(steps).alias("s"))
    pred = F.when(F.col("level") > F.col("s.j"), F.col("pred") if joint else F.lit(1)).otherwise(0)
    gold = F.col("gold") if joint else (F.col("gold") > 0).cast("int")
    at = spread.select("s.threshold", "code", "n", pred.alias("pred"), gold.alias("gold"))
    hit = F.when((F.col("gold") > 0) & (F.col("gold") == F.col("pred")), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("gold").alias("cls"), F.col("n").alias("g"), F.lit(0).cast("bigint").alias("p"), hit.alias("tp")),
        F.struct(F.col("pred").alias("cls"), F.lit(0).cast("bigint").alias("g"), F.col("n").alias("p"), F.lit(0).alias("tp")),
    )
    opened = at.select("threshold", "code", F.explode(sides).alias("x")).where(F.col("x.cls") > 0)
    counted = opened.groupBy("threshold", "code", "x.cls").agg(F.sum("x.tp").alias("tp"), F.sum("x.g").alias("g"), F.sum("x.p").alias("p"))
    f1 = ratio(2.0 * F.col("tp"), F.col("g") + F.col("p"))
    return counted.groupBy("threshold").agg(
        ratio(2.0 * F.sum("tp"), F.sum("g") + F.sum("p")).alias(f"{prefix}micro_f1"),
        (F.sum(f1) / F.lit(float(n_cells))).alias(f"{prefix}macro_f1"),
    )


def threshold_table(rows: DataFrame, classes: DataFrame | Sequence[str], max_labels: int = 6, joint: bool = False) -> DataFrame:
    """F1 at each of the 17 thresholds. ``rows`` has ``ranked`` and ``gold`` (``gold_map`` when joint)."""
    names = class_list(classes)
    cells = _threshold_cells(rows, max_labels, joint)
    base = rows.sparkSession.createDataFrame([(t,) for t in THRESHOLDS], "threshold double")
    table = base.join(_f1_by_threshold(cells, len(names), False, ""), "threshold", "left")
    if joint:
        table = table.join(_f1_by_threshold(cells, 3 * len(names), True, "joint_"), "threshold", "left")
    return table.na.fill(0.0)


def best_threshold(table: DataFrame, metric: str = "micro_f1") -> DataFrame:
    """Best metric, ties to the higher threshold; rounding keeps summation order out of ties."""
    if metric not in table.columns or metric == "threshold":
        raise ValueError(f"metric must be one of {[c for c in table.columns if c != 'threshold']}.")
    best = F.max(F.struct(F.round(metric, 12).alias("value"), F.col("threshold")))
    return table.agg(best.alias("b")).select(F.coalesce("b.threshold", F.lit(0.5)).alias("threshold"))


def threshold_search(
    scores: DataFrame, gold: DataFrame, classes: DataFrame | Sequence[str], metric: str = "micro_f1", max_labels: int = 6
) -> float:
    """The threshold to store with a model; 0.5 where there is no validation row."""
    rows = scored_rows(gold, scores)
    if rows.isEmpty():
        return 0.5
    return best_threshold(threshold_table(rows, classes, max_labels), metric).collect()[0]["threshold"]


def presence_threshold_search(
    probs: DataFrame, gold: DataFrame, classes: DataFrame | Sequence[str], metric: str = "joint_micro_f1", max_labels: int = 6
) -> float:
    rows = paired_rows(probs, gold)
    if rows.isEmpty():
        return 0.5
    return best_threshold(threshold_table(rows, classes, max_labels, joint=True), metric).collect()[0]["threshold"]


def paired_rows(probs: DataFrame, gold: DataFrame) -> DataFrame:
    """``(row_id, ranked, gold_pairs, gold_map)`` from class probabilities and gold annotations."""
    as_map = F.map_from_entries(F.transform("gold_pairs", lambda p: F.struct(p["code"], p["sentiment"])))
    return gather_pair_scores(probs).join(gold.select("row_id", "gold_pairs", as_map.alias("gold_map")), "row_id")


# ---- saved predictions and run statistics ----------------------------------------------------


def _percentiles(grouped: DataFrame, n: int, shares: Sequence[float]) -> list[float]:
    """Percentiles of ``ticks`` that occur ``n`` times in all, between the two values around each rank.

    ``grouped`` has ``ticks, n``. The values at the ranks are found by counting eight bits at a time; no task holds all values.
    """
    if not n:
        return [0.0] * len(shares)
    places = sorted({i for q in shares for i in (math.floor(q * (n - 1)), math.ceil(q * (n - 1)))})
    least = grouped.agg(F.min("ticks")).first()[0]
    asked = grouped.select((F.col("ticks") - least).alias("ticks"), "n", F.explode(F.array(*[F.lit(str(i)) for i in places])).alias("place"))
    found = nth_largest(asked, "ticks", {str(i): n - i for i in places}, "place", "n")
    at = {i: found[str(i)][0] + least for i in places}
    ranks = [(q * (n - 1), math.floor(q * (n - 1)), math.ceil(q * (n - 1))) for q in shares]
    return [(at[lo] + (at[hi] - at[lo]) * (rank - lo)) / 1e4 for rank, lo, hi in ranks]


def run_statistics(df: DataFrame, wall_seconds: float, concurrency: int) -> DataFrame:
    """Counts, latency sums and percentiles, token sums of an annotation run.

    Latencies are stored with four decimals, so grouping by value first leaves few distinct values, however many rows there are.
    """
    ticks = F.coalesce(F.round(F.col("latency_seconds").cast("double") * 10_000), F.lit(0.0)).cast("bigint")
    failed = F.coalesce("llm_error", F.lit("")) != ""
    grouped = df.groupBy(ticks.alias("ticks")).agg(
        F.count("*").alias("n"),
        F.count_if(failed).alias("failed"),
        F.count_if(F.coalesce("needs_review", F.lit(True))).alias("review"),
        F.sum(F.coalesce("prompt_tokens", F.lit(0))).alias("prompt"),
        F.sum(F.coalesce("completion_tokens", F.lit(0))).alias("completion"),
    )
    grouped = materialize(grouped, "latencies")
    total = F.sum("n")
    n = grouped.agg(F.coalesce(total, F.lit(0))).first()[0]
    half, most = _percentiles(grouped, n, (0.5, 0.95))
    seconds = F.lit(float(wall_seconds))
    latency = F.sum(F.col("ticks") / 1e4 * F.col("n"))
    return grouped.agg(
        F.coalesce(total, F.lit(0)).alias("input_rows"),
        F.coalesce(total - F.sum("failed"), F.lit(0)).alias("successful_rows"),
        F.coalesce(F.sum("failed"), F.lit(0)).alias("failed_rows"),
        F.coalesce(F.sum("review"), F.lit(0)).alias("needs_review_rows"),
        F.coalesce(F.sum("review") / total, F.lit(0.0)).alias("needs_review_rate"),
        F.coalesce(latency, F.lit(0.0)).alias("latency_seconds_total"),
        F.coalesce(latency / total, F.lit(0.0)).alias("latency_seconds_mean"),
        F.coalesce(F.sum("prompt"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum("completion"), F.lit(0)).alias("completion_tokens"),
    ).select(
        "input_rows", "successful_rows", "failed_rows", "needs_review_rows", "needs_review_rate", "latency_seconds_total",
        "latency_seconds_mean", F.lit(half).alias("latency_seconds_p50"), F.lit(most).alias("latency_seconds_p95"),
        "prompt_tokens", "completion_tokens", seconds.alias("wall_time_seconds"),
        F.when(seconds > 0, F.col("input_rows") / seconds).otherwise(0.0).alias("throughput_rows_per_second"),
        F.lit(concurrency).alias("concurrency"),
    )


def saved_pair_rows(df: DataFrame, classes: Sequence[str], gold_col: str, pred_col: str, keep: bool = False) -> DataFrame:
    """A saved prediction table with its gold and predicted labels parsed and limited to known codes."""
    known = _literal_array(classes)
    limited = lambda c: F.filter(parse_code_sentiments(F.col(c))["labels"], lambda p: F.array_contains(known, p["code"]))
    marked = df.withColumn("gold_pairs", limited(gold_col)).withColumn("pred_pairs", limited(pred_col))
    return marked if keep else marked.where(F.size("gold_pairs") > 0)


def check_labels(df: DataFrame, column: str) -> None:
    """Fails with the column and source line if any label of the column does not parse."""
    bad = df.where(parse_code_sentiments(F.col(column))["status"] != "ok").select("row_id").limit(1).collect()
    if bad:
        raise ValueError(f"Column {column!r} has a cell that is no list of code and sentiment, first on line {bad[0]['row_id'] + 2}.")


# The names of joint figures; the others of the same family are not reported.
_JOINT = {
    "micro_precision": "joint_micro_precision", "micro_recall": "joint_micro_recall", "micro_f1": "joint_micro_f1",
    "macro_f1": "joint_macro_f1", "subset_accuracy": "joint_subset_accuracy",
}
_PAIR_COUNTS = ("pairs", "hits", "found")


class Evaluation:
    """Counts of gold and predicted pairs from which every family of metrics follows: one pass over the rows, one shuffle.

    ``rows`` has ``gold_pairs`` and ``pred_pairs``, arrays of (code, sentiment). Rows without gold are counted and not evaluated. A cell is
    one code, or one code with a sentiment, or the row itself (no label); cells of different tables add up.
    """

    def __init__(self, rows: DataFrame, classes: DataFrame | Sequence[str], written: bool = False):
        self.names = class_list(classes)
        self.spark = rows.sparkSession
        gold, pred = F.col("gold_pairs"), F.col("pred_pairs")
        codes = rows.select(gold, pred, _codes_of(gold).alias("_gc"), _codes_of(pred).alias("_pc"), _pair_labels(gold).alias("_gp"), _pair_labels(pred).alias("_pp"))
        of = lambda pairs, code: F.size(F.filter(pairs, lambda p: p["code"] == code)).cast("bigint")

        def sentiments(code: Column) -> dict[str, Column]:
            pairs = of(F.array_distinct(gold), code)
            return {"pairs": pairs, "hits": of(F.array_intersect(gold, pred), code), "found": F.when(F.array_contains("_pc", code), pairs).otherwise(0)}

        first = F.try_element_at("_pc", F.lit(1))
        by_code = _event_array(F.col("_gc"), F.col("_pc"), first, None, sentiments)
        by_pair = _event_array(F.col("_gp"), F.col("_pp"), F.try_element_at("_pp", F.lit(1)), None, lambda code: dict.fromkeys(_PAIR_COUNTS, F.lit(0).cast("bigint")))
        tagged = lambda events, family: F.transform(events, lambda e: F.struct(F.lit(family).alias("family"), e.alias("e")))
        evaluated = F.concat(tagged(by_code, "code"), tagged(by_pair, "pair"))
        # A row without gold counts as a row of its own family only.
        alone = F.transform(F.slice(by_code, 1, 1), lambda e: F.struct(F.lit("skipped").alias("family"), e.alias("e")))
        events = codes.select(F.explode(F.when(F.size(gold) > 0, evaluated).otherwise(alone)).alias("x")).select("x.family", "x.e.*")
        cells = events.groupBy("family", "label").agg(*[F.sum(n).alias(n) for n in (*_COUNTS, *_PAIR_COUNTS)])
        self.cells = materialize(cells, "evaluation") if written else cells

    def statistics(self, accounting: bool = True) -> DataFrame:
        """All figures in one row."""
        family = F.col("family")
        sums = self.cells.agg(
            *_sums("code_", family == "code"), *_sums("pair_", family == "pair"),
            *[F.coalesce(F.sum(F.when(family == "code", F.col(n))), F.lit(0)).alias(n) for n in _PAIR_COUNTS],
            F.coalesce(F.sum(F.when(family == "skipped", F.col("rows"))), F.lit(0)).alias("skipped"),
        )
        rows = [
            (F.col("code_rows") + F.col("skipped")).alias("input_rows"), F.col("code_rows").alias("evaluated_rows"),
            F.col("skipped").alias("rows_without_known_gold_codes"),
        ]
        codes = [c.alias(n) for n, c in _figures(len(self.names), "code_").items() if n not in ("n_rows", "lrap")]
        joint = [c.alias(_JOINT[n]) for n, c in _figures(3 * len(self.names), "pair_").items() if n in _JOINT]
        sentiments = [
            ratio(F.col("hits"), F.col("pairs"), None).alias("gold_code_sentiment_accuracy"),
            ratio(F.col("hits"), F.col("found"), None).alias("detected_gold_sentiment_accuracy"),
            F.col("code_g").alias("gold_codes"), F.col("code_tp").alias("detected_gold_codes"),
            F.col("pairs").alias("gold_code_sentiment_pairs"), F.col("found").alias("gold_pairs_with_detected_code"),
        ]
        return sums.select(*(rows if accounting else []), *codes, *joint, *sentiments)

    def per_code(self) -> DataFrame:
        """Support, precision, recall, F1 and sentiment accuracies of every code, largest support first."""
        base = self.spark.createDataFrame([(c,) for c in self.names], "code string")
        counted = self.cells.where((F.col("family") == "code") & F.col("label").isNotNull()).withColumnRenamed("label", "code")
        return base.join(counted.select("code", "tp", "g", "p", *_PAIR_COUNTS), "code", "left").na.fill(0).select(
            "code", F.col("g").alias("support"), ratio(F.col("tp"), F.col("p")).alias("precision"), ratio(F.col("tp"), F.col("g")).alias("recall"),
            ratio(2.0 * F.col("tp"), F.col("g") + F.col("p")).alias("f1"),
            ratio(F.col("hits"), F.col("pairs"), None).alias("gold_code_sentiment_accuracy"),
            ratio(F.col("hits"), F.col("found"), None).alias("detected_gold_sentiment_accuracy"),
        ).orderBy(F.desc("support"), "code")


def evaluate_saved(df: DataFrame, classes: DataFrame | Sequence[str], gold_col: str, pred_col: str) -> DataFrame:
    """All metrics of a saved prediction table in one row; its label columns are parsed once."""
    names = class_list(classes)
    return Evaluation(saved_pair_rows(df, names, gold_col, pred_col, keep=True), names).statistics()


def side_by_side(parts: Sequence[DataFrame]) -> DataFrame:
    """One-row tables next to each other, joined on a constant."""
    keyed = [p.withColumn("_one", F.lit(1)) for p in parts]
    table = keyed[0]
    for part in keyed[1:]:
        table = table.join(part, "_one")
    return table.drop("_one")


def evaluate_code_lists(df: DataFrame, classes: Sequence[str], gold_col: str, pred_col: str = "predicted_codes") -> DataFrame:
    """Metrics of a table whose gold and predictions are code lists in text form."""
    marked = evaluation_mask(df, split_codes(F.col(gold_col)), split_codes(F.col(pred_col)), classes, keep=True)
    evaluated = marked.where(F.size("gold") > 0)
    return side_by_side([row_accounting(marked), overall_metrics(evaluated, classes).drop("n_rows")])


def merge_statistics(existing: dict, new: dict) -> dict:
    """New values win over stored ones with the same name."""
    return {**existing, **new}
