"""Complete jobs: training, indexing, classification, annotation, evaluation."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import parse_code_sentiments, split_codes
from ..functions.text import clean_text, combine_text
from ..operators import annotation as ann
from ..operators import metrics as mx
from ..operators.codebook import assignable_codes, enrich, unknown_codes
from ..operators.decode import ENCODER_RULES, LINEAR_RULES, PAIR_RULES, DecodeRules, pair_prediction_report, prediction_columns, prediction_report, rank_arrays, rank_pair_arrays
from ..operators.index import EmbeddingIndex, Encoder, build_index, classify_by_index, encode
from ..operators.linear import MAX_FIT_ENTRIES, MAX_FIT_ROWS, TextModel, cut_and_fit, model_summary, score_arrays, score_texts
from ..operators.mining import class_sizes, contrastive_negatives, mining_tables, positive_pairs, text_digest, triplets
from ..operators.pairs import build_pairs, class_weights, pair_distribution
from ..operators.responses import attach, explode_codes, parse_responses, require_columns, require_rows, usable_rows
from ..operators.scorers import MultilabelModel, PairModel, long_pairs, multilabel_arrays, pair_arrays, pair_codes
from ..operators.splits import ensure_train_coverage, in_split, label_distribution, split_summary, split_train_val_test, stratum_of_annotations, stratum_of_codes
from ..settings import fresh_path, materialize
from ..sources.ledger import Ledger
from ..sources.stores import report_paths, save_index, save_splits, save_text_model, write_config, write_reports
from ..sources.tables import write_table


def load_labelled(df: DataFrame, codebook: DataFrame, text_col: str, codes_col: str, context_col: str | None = None) -> DataFrame:
    """Usable labelled responses; fails if a code is absent from the codebook."""
    rows = usable_rows(parse_responses(df, text_col, codes_col, context_col))
    unknown_codes(explode_codes(rows.select("row_id", "codes")), codebook, strict=True)
    return require_rows(rows)


def train_text_model(
    df: DataFrame, codebook: DataFrame, text_col: str, codes_col: str, context_col: str | None = None, out: str | None = None,
    val: float = 0.1, test: float = 0.1, seed: int = 42, min_df: int = 2, word_features: int | None = 100_000,
    char_features: int | None = 150_000, C: float = 4.0, max_iter: int = 1000, metric: str = "micro_f1", max_labels: int = 6,
) -> tuple[TextModel, dict[str, DataFrame]]:
    """Load, split, fit on train, choose the threshold on validation, report on every split."""
    rows = load_labelled(df, codebook, text_col, codes_col, context_col).withColumn("stratum", stratum_of_codes(F.col("codes")))
    split = ensure_train_coverage(split_train_val_test(rows, val, test, seed))
    split = materialize(split, "split-responses")
    train = split.where(F.col("split") == "train")
    model = cut_and_fit(split, train, min_df=min_df, word_features=word_features, char_features=char_features, C=C, max_iter=max_iter)
    scores = materialize(score_texts(model, split), "split-scores")
    gold = split.select("row_id", "split", F.col("codes").alias("gold"))
    val_gold = gold.where(F.col("split") == "val")
    threshold = mx.threshold_search(scores.join(val_gold, "row_id", "left_semi"), val_gold, model.classes, metric, max_labels)
    model = replace(model, threshold=threshold, max_labels=max_labels, config={**model.config, "C": C, "min_df": min_df, "seed": seed})
    classes = rows.sparkSession.createDataFrame([(c,) for c in model.classes], "code string")
    reports: dict[str, DataFrame] = {"label_distribution": label_distribution(split, classes, codebook), "splits": split}
    for name in ("train", "val", "test"):
        part = split.where(F.col("split") == name)
        evaluated = mx.scored_rows(part.select("row_id", F.col("codes").alias("gold")), scores)
        report = prediction_report(part, scores, threshold, max_labels)
        reports[f"{name}_metrics"] = mx.score_metrics(evaluated, model.classes, threshold, max_labels)
        reports[f"{name}_per_class"] = mx.per_code_report(mx.decoded_rows(evaluated, threshold, max_labels), model.classes)
        reports[f"{name}_predictions"] = report
        reports[f"{name}_errors"] = report.where(~F.col("correct"))
    if out:
        save_text_model(model, f"{out}/model", codebook)
        save_splits(split, f"{out}/splits")
        for name, table in reports.items():
            if name != "splits":
                write_table(table, f"{out}/reports/{name}", "parquet")
        sizes = model_summary(model).first().asDict()
        settings = {
            "model_type": "tfidf_one_vs_rest_logistic", "text_col": text_col, "codes_col": codes_col, "context_col": context_col, "seed": seed, "val": val, "test": test,
            "min_df": min_df, "word_ngrams": [1, 2], "char_ngrams": [3, 5], "word_features": word_features, "char_features": char_features, "C": C,
            "max_iter": max_iter, "max_rows": MAX_FIT_ROWS, "max_entries": MAX_FIT_ENTRIES, "threshold_metric": metric, "threshold": threshold, "max_labels": max_labels,
        }
        write_config(df.sparkSession, run_report(df, split, settings | sizes | {"classes": model.classes, "without_rows": model.config["without_rows"]}, {
            name: reports[f"{name}_metrics"].first().asDict() for name in ("train", "val", "test")
        }), f"{out}/config")
    return model, reports


def run_report(source: DataFrame, split: DataFrame, settings: dict, metrics: dict | None = None) -> dict:
    """The configuration of a run as one document: when, all settings, what was read and used, rows of each split, metrics of each split."""
    rows = {r["split"]: r["n"] for r in split.groupBy("split").agg(F.count("*").alias("n")).collect()}
    read, used = source.count(), sum(rows.values())
    return settings | {
        "created_at": datetime.now(UTC).isoformat(timespec="seconds"), "split_rows": {name: rows.get(name, 0) for name in ("train", "val", "test")},
        "data_report": {"rows_read": read, "rows_used": used, "rows_skipped": read - used}, "metrics": metrics or {},
    }


def _source_with_text(df: DataFrame, text_col: str, context_col: str | None, prefix: str | None = None) -> DataFrame:
    require_columns(df, [c for c in ("row_id", text_col, context_col) if c])
    context = F.col(context_col) if context_col else None
    shown = clean_text(context) if context is not None else F.lit("")
    return df.select("row_id", combine_text(F.col(text_col), context, prefix).alias("text"), clean_text(F.col(text_col)).alias("answer"), shown.alias("context"))


def _finish(source: DataFrame, predictions: DataFrame, classes: list[str], gold_col: str | None, out: str | None) -> DataFrame:
    """Attaches predictions to the source, writes them, and evaluates where gold is given."""
    result = attach(source, predictions)
    if out is None:
        return result
    write_table(result, out, "parquet")
    stored = source.sparkSession.read.parquet(out)
    if gold_col:
        marked = mx.evaluation_mask(stored, split_codes(F.col(gold_col)), split_codes(F.col("predicted_codes")), classes, keep=True)
        evaluated = marked.where(F.size("gold") > 0)
        stats = mx.side_by_side([mx.row_accounting(marked), mx.overall_metrics(evaluated, classes).drop("n_rows")])
        write_reports(out, stats, mx.per_code_report(evaluated, classes), mx.error_rows(evaluated).drop("gold", "pred"))
    return stored


def classify_with_text_model(
    df: DataFrame, model: TextModel, codebook: DataFrame, text_col: str, context_col: str | None = None, gold_col: str | None = None,
    top_k: int = 5, threshold: float | None = None, max_labels: int | None = None, margin: float = 0.05, out: str | None = None,
) -> DataFrame:
    """The test for an empty text is on the combined text, so a context makes it non-empty."""
    texts = _source_with_text(df, text_col, context_col)
    gathered = rank_arrays(score_arrays(model, texts, (F.col("text") == "").alias("blank_text")), model.classes)
    chosen = model.threshold if threshold is None else threshold
    predictions = prediction_columns(
        gathered, codebook, chosen, max_labels or model.max_labels, top_k, margin, LINEAR_RULES, blank=F.col("blank_text")
    )
    return _finish(df, predictions, model.classes, gold_col, out)


def classify_with_scorer(
    df: DataFrame, scorer: MultilabelModel, classes: list[str], codebook: DataFrame, text_col: str, context_col: str | None = None,
    gold_col: str | None = None, threshold: float = 0.5, max_labels: int = 6, top_k: int = 5, margin: float = 0.05,
    batch_size: int = 64, rules: DecodeRules = ENCODER_RULES, out: str | None = None,
) -> DataFrame:
    """Multi-label classification with any model that maps texts to one score per class."""
    scored = multilabel_arrays(_source_with_text(df, text_col, context_col), scorer, classes, batch_size)
    predictions = prediction_columns(rank_arrays(scored, classes), codebook, threshold, max_labels, top_k, margin, rules)
    return _finish(df, predictions, classes, gold_col, out)


def classify_with_pair_model(
    df: DataFrame, model: PairModel, codebook: DataFrame, text_col: str, context_col: str | None = None, prefix: str | None = None,
    threshold: float = 0.5, max_labels: int = 6, top_k: int = 5, margin: float = 0.05, batch_size: int = 64, out: str | None = None,
    gold_codes_col: str | None = None, gold_sentiments_col: str | None = None,
) -> DataFrame:
    """Code and sentiment of each leaf of the active codebook, from a pair model.

    With ``out`` and gold columns the predictions are evaluated: statistics, a report per code, one per model class, and the
    rows that differ are written beside them. Rows with conflicting gold are counted and left out; other faults are errors.
    """
    texts = _source_with_text(df, text_col, context_col, prefix)
    leaves = assignable_codes(codebook)
    gold = _pair_gold(df, gold_codes_col, gold_sentiments_col, leaves) if out and gold_codes_col else None
    scored, codes = pair_arrays(texts, codebook, model, batch_size), pair_codes(codebook)
    if gold is not None:
        scored = materialize(scored, "pair-probabilities")
    predictions = prediction_columns(rank_pair_arrays(scored, codes), codebook, threshold, max_labels, top_k, margin, PAIR_RULES, with_sentiments=True)
    stored = _finish(df, predictions, leaves, None, out)
    if gold is not None:
        _evaluate_pairs(stored, long_pairs(scored, codes), gold, leaves, out)
        rows = texts.join(gold.where("valid"), "row_id").select("row_id", "answer", "context", F.col("gold_pairs").alias("annotations"))
        report = pair_prediction_report(rows, scored, codebook, threshold, max_labels)
        write_table(report, report_paths(out)["pair_predictions"], "csv")
    return stored


def _pair_gold(df: DataFrame, codes_col: str, sentiments_col: str | None, leaves: list[str]) -> DataFrame:
    """``row_id, gold_pairs, valid``; fails on the first row whose gold is faulty but not conflicting."""
    require_columns(df, [c for c in (codes_col, sentiments_col) if c])
    sentiments = F.col(sentiments_col) if sentiments_col else None
    marked = mx.gold_targets(df, F.col(codes_col), sentiments, leaves).select("row_id", "gold_pairs", "status", "valid")
    faulty = marked.where(~F.col("status").isin("ok", "conflict")).limit(1).collect()
    if faulty:
        raise ValueError(f"Gold of line {faulty[0]['row_id'] + 2} cannot be used: {faulty[0]['status']}.")
    return marked.select("row_id", "gold_pairs", "valid")


def _evaluate_pairs(stored: DataFrame, probs: DataFrame, gold: DataFrame, leaves: list[str], out: str) -> None:
    predicted = stored.withColumn("pred_pairs", parse_code_sentiments(F.col("predicted_code_sentiments"))["labels"])
    valid = gold.where("valid")
    rows = materialize(valid.select("row_id", "gold_pairs").join(predicted, "row_id"), "pair-rows")
    label = F.aggregate(
        "gold_pairs", F.lit(0), lambda found, p: F.when(p["code"] == F.col("code"), p["sentiment"] + 1).otherwise(found)
    )
    cells = probs.join(valid.select("row_id", "gold_pairs"), "row_id").select(label.alias("label"), "probs")
    confusion = materialize(mx.pair_confusion(cells), "pair-confusion")
    counts = gold.agg(
        F.count("*").alias("input_rows"), F.count_if("valid").alias("evaluated_rows"), F.count_if(~F.col("valid")).alias("skipped_conflicts"),
        F.lit(len(leaves)).alias("n_leaf_codes"),
    )
    named = mx.pair_metrics_of(confusion)
    named = named.select(*(F.col(c).alias(f"pair_{c}") for c in named.columns))
    codes = mx.overall_metrics(mx.presence_rows(rows), leaves).drop("n_rows")
    joint = mx.joint_metrics(rows, leaves).drop("n_rows")
    stats = mx.side_by_side([counts, codes, joint, mx.sentiment_accuracy(rows, leaves, single=True), named])
    errors = mx.error_rows(rows, "gold_pairs", "pred_pairs").drop("gold_pairs", "pred_pairs")
    write_reports(out, stats, mx.joint_report(rows, leaves), errors, mx.pair_class_report(confusion))


def classify_with_index(
    df: DataFrame, index: EmbeddingIndex, text_col: str, context_col: str | None = None, gold_col: str | None = None,
    encoder: Encoder | None = None, out: str | None = None, **options,
) -> DataFrame:
    """Encodes with the prefix stored in the index, then classifies by centroids."""
    texts = _source_with_text(df, text_col, context_col)
    prefix = index.config.get("input_prefix", "")
    vectors = materialize(encode(texts.select("row_id", "text"), "text", encoder, prefix=prefix).select("row_id", "embedding"), "vectors")
    return _finish(df, classify_by_index(vectors, index, **options), mx.class_list(index.code_centroids), gold_col, out)


def build_index_job(
    df: DataFrame, codebook: DataFrame, text_col: str, codes_col: str, context_col: str | None = None, out: str | None = None,
    use: str = "train", val: float = 0.1, test: float = 0.1, seed: int = 42, encoder: Encoder | None = None, prefix: str = "",
) -> tuple[EmbeddingIndex, DataFrame]:
    """Load, split, index the train split or everything. Returns the index and the split table."""
    if use not in ("train", "all"):
        raise ValueError("use must be 'train' or 'all'.")
    rows = load_labelled(df, codebook, text_col, codes_col, context_col).withColumn("stratum", stratum_of_codes(F.col("codes")))
    split = split_train_val_test(rows, val, test, seed)
    kept = rows if use == "all" else in_split(rows, split.select("row_id", "split"), "train")
    long = enrich(explode_codes(kept.select("row_id", "text", "codes")), codebook, "inner")
    encoded = materialize(encode(long, "text", encoder, prefix=prefix), "examples")
    index = build_index(encoded, codebook, encoder, prefix=prefix)
    if out:
        save_index(index, f"{out}/index")
        save_splits(split, f"{out}/splits")
        write_table(split_summary(explode_codes(split.select("row_id", "split", "codes"))), f"{out}/split_summary", "parquet")
        settings = {
            "model_type": "embedding_index", "text_col": text_col, "codes_col": codes_col, "context_col": context_col, "use": use, "val": val, "test": test, "seed": seed,
            "input_prefix": prefix,
        }
        write_config(df.sparkSession, run_report(df, split, settings), f"{out}/config")
    return index, split


def prepare_training_tables(
    df: DataFrame, codebook: DataFrame, out: str | None = None, negative_ratio: float | None = 3.0, seed: int = 42,
    min_class_size: int = 10, max_pairs: int = 5000,
) -> dict[str, DataFrame]:
    """Pair table, contrastive pairs and triplets as tables for an external trainer.

    ``df`` has ``row_id, text, answer, context, annotations``.
    """
    rows = df.withColumn("codes", F.transform("annotations", lambda a: a["code"])).withColumn(
        "stratum", stratum_of_annotations(F.col("annotations"))
    )
    # The steps of the split read keys and labels several times; labels are parsed and texts cleaned once, for these files.
    rows = materialize(rows.withColumn("digest", text_digest(F.col("text"))), "annotated-rows")
    split = ensure_train_coverage(split_train_val_test(rows, seed=seed))
    split = split.withColumn("sentiments", F.transform("annotations", lambda a: a["sentiment"]))
    split = materialize(ensure_train_coverage(split, "sentiments").drop("sentiments"), "split-annotated")
    train = split.where(F.col("split") == "train")
    pairs = build_pairs(split, codebook, negative_ratio, seed).join(split.select("row_id", "split"), "row_id")
    long = explode_codes(train.select("row_id", "text", "digest", "codes"))
    prepared = mining_tables(long)
    tables = {
        "pairs": pairs,
        "class_weights": class_weights(pairs.where(F.col("split") == "train")),
        "pair_distribution": pair_distribution(pairs),
        "positive_pairs": positive_pairs(long, min_class_size, max_pairs, seed, prepared),
        "negative_pairs": contrastive_negatives(long, min_class_size, max_pairs, seed=seed, prepared=prepared),
        "triplets": triplets(long, min_class_size, max_pairs, seed, prepared),
        "class_sizes": class_sizes(long),
    }
    if out:
        for name, table in tables.items():
            write_table(table, f"{out}/{name}", "parquet")
        by_split = df.sparkSession.read.parquet(f"{out}/pairs").groupBy("split").agg(F.count("*").alias("n")).collect()
        settings = {"negative_ratio": negative_ratio, "seed": seed, "min_class_size": min_class_size, "max_pairs": max_pairs, "model_classes": ["absent", "neutral", "positive", "negative"]}
        write_config(df.sparkSession, run_report(df, split, settings | {"split_pairs": {r["split"]: r["n"] for r in by_split}}), f"{out}/config")
    return tables


def annotate(
    df: DataFrame, codebook: DataFrame, client: ann.Client, text_col: str, context_col: str | None = None, prefix: str | None = None,
    gold_col: str | None = None, max_labels: int = 6, max_retries: int = 2, partitions: int | None = None, concurrency: int = 8,
    wall_seconds: float = 0.0, out: str | None = None, ledger: str | None = None, slice_rows: int = ann.SLICE_ROWS, retry_failed: bool = True,
    structured_output: bool = False, on_slice: Callable[[int, int], None] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Requests, replies, parsed labels and run statistics. Gold labels are checked before any request.

    Replies are kept in ``ledger``, a folder that later runs may name again: they ask only what it does not hold (and what failed, unless
    ``retry_failed`` is off). ``wall_seconds`` is for callers that know the time of the requests; otherwise it is measured here.
    """
    require_columns(df, [c for c in ("row_id", text_col, context_col, gold_col) if c])
    if gold_col:
        mx.check_labels(df, gold_col)
    spark = df.sparkSession
    shared = ann.instructions(codebook, max_labels)
    codes = shared.codes
    requests = ann.build_requests(df, shared, text_col, context_col, prefix)
    kept = Ledger(spark, ledger or fresh_path(spark, "ledger"), df.schema["row_id"].dataType.simpleString())
    began = time.perf_counter()
    # Keys without prompts: to count the requests and to find their replies, the prompts need not be made again.
    keys = materialize(requests.select("row_id", "request_key", "filled"), "request-keys")
    ann.ask_rest(
        requests, client, shared, kept, slice_rows, retry_failed, on_slice, keys.where("filled").count(), max_retries=max_retries,
        partitions=partitions, concurrency=concurrency, structured_output=structured_output,
    )
    wall_seconds = wall_seconds or time.perf_counter() - began
    replies = ann.collect_replies(keys, kept)
    columns = ann.annotation_columns(ann.parse_replies(replies, codes, max_labels), codebook)
    target = out or fresh_path(spark, "annotated")
    result = attach(df, columns)
    result.write.mode("overwrite").parquet(target)
    stored = spark.read.schema(result.schema).parquet(target)
    stats, per_code, errors = mx.run_statistics(stored, wall_seconds, concurrency), None, None
    if gold_col:
        rows = mx.saved_pair_rows(stored, codes, gold_col, "predicted_code_sentiments", keep=True)
        evaluation = mx.Evaluation(rows, codes, written=True)
        stats, per_code = mx.side_by_side([stats, evaluation.statistics().drop("input_rows")]), evaluation.per_code()
        errors = mx.error_rows(rows.where(F.size("gold_pairs") > 0), "gold_pairs", "pred_pairs").drop("gold_pairs", "pred_pairs")
    if out:
        write_reports(out, stats, per_code, errors)
    return stored, stats


def evaluate_saved_job(
    spark: SparkSession, path: str, codebook: DataFrame, gold_col: str, pred_col: str = "predicted_code_sentiments",
    existing: dict | None = None, fmt: str = "parquet", out: str | None = None,
) -> tuple[dict, DataFrame]:
    """Metrics of a stored prediction table, merged over earlier statistics.

    With ``out``, the name of a prediction table, the merged statistics, the report per code and the rows that differ are
    written under its report names and replace what is there.
    """
    stored = spark.read.format(fmt).load(path)
    codes = assignable_codes(codebook, fallback_to_all=True)
    rows = mx.saved_pair_rows(stored, codes, gold_col, pred_col, keep=True)
    evaluation = mx.Evaluation(rows, codes, written=True)
    merged, report = mx.merge_statistics(existing or {}, evaluation.statistics().first().asDict()), evaluation.per_code()
    if out:
        paths = report_paths(out)
        write_config(spark, merged, paths["stats"])
        write_table(report, paths["per_class"], "csv")
        write_table(mx.error_rows(rows.where(F.size("gold_pairs") > 0), "gold_pairs", "pred_pairs").drop("gold_pairs", "pred_pairs"), paths["errors"], "csv")
    return merged, report
