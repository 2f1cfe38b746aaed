import pytest
from pyspark.sql import functions as F

from codeloom.operators import decode as dec
from codeloom.operators import metrics as mx

CODES = ["A1", "A2", "B1"]


def long_scores(spark, matrix):
    return spark.createDataFrame([(i, c, float(s)) for i, row in enumerate(matrix) for c, s in zip(CODES, row)], "row_id bigint, code string, score double")


def test_multilabel_format(spark, small_codebook):
    gathered = dec.gather_scores(long_scores(spark, [[0.55, 0.31, 0.92], [0.49, 0.02, 0.12], [0.5, 0.47, 0.5]]))
    rows = dec.prediction_columns(gathered, small_codebook, 0.5, 6, 2, 0.05, dec.ENCODER_RULES).orderBy("row_id").collect()
    assert [r["predicted_codes"] for r in rows] == ["B1, A1", "UNKNOWN", "A1, B1"]
    assert [r["predicted_parent_codes"] for r in rows] == ["B, A", "", "A, B"]
    assert [r["predicted_names"] for r in rows] == ["Office; Salary", "UNKNOWN", "Salary; Office"]
    # The second has no code, the third a tie for the best.
    assert [r["needs_review"] for r in rows] == [False, True, True]
    assert [r["top_candidates"] for r in rows] == ["B1:0.9200; A1:0.5500", "A1:0.4900; B1:0.1200", "A1:0.5000; B1:0.5000"]


def test_names_by_map_and_by_join(spark, small_codebook, monkeypatch):
    scores = long_scores(spark, [[0.55, 0.31, 0.92], [0.49, 0.02, 0.12], [0.6, 0.7, 0.8]]).unionByName(spark.createDataFrame([(2, "NEW", 0.65)], "row_id bigint, code string, score double"))
    read = lambda: sorted(map(str, dec.prediction_columns(dec.gather_scores(scores), small_codebook, 0.5, 6, 2, 0.05, dec.LINEAR_RULES).collect()))
    by_map = read()
    assert "NEW" in by_map[-1]
    monkeypatch.setattr(dec, "MAX_MAPPED_CODES", 2)
    assert read() == by_map


def test_index_rules_differ(spark, small_codebook):
    gathered = dec.gather_scores(long_scores(spark, [[0.9, 0.88, 0.1]]))
    top1 = dec.prediction_columns(gathered, small_codebook, 0.5, 6, 1, 0.05, dec.INDEX_RULES).first()
    assert (top1["predicted_codes"], top1["margin"], top1["needs_review"]) == ("A1", 1.0, False)
    linear = dec.prediction_columns(gathered, small_codebook, 0.5, 6, 1, 0.05, dec.LINEAR_RULES).first()
    assert (linear["predicted_codes"], linear["margin"], linear["needs_review"]) == ("A1, A2", 0.02, True)
    with pytest.raises(ValueError):
        dec.decode(long_scores(spark, [[0, 0, 0]]), 1.5)


def test_perfect_scores(spark):
    labels = {10: {"B1", "A1"}, 11: {"A2"}, 12: {"A1", "A2", "B1"}, 13: {"A1"}}
    # What is gold scores 0.62 or more, the rest 0.38 or less.
    cells = [(n, c, (0.62 if c in own else 0.3) + 0.02 * ((n + ord(c[1])) % 5)) for n, own in labels.items() for c in CODES]
    scores = spark.createDataFrame(cells, "row_id bigint, code string, score double")
    gold = spark.createDataFrame([(n, sorted(own)) for n, own in labels.items()], "row_id bigint, gold array<string>")
    rows = mx.scored_rows(gold, scores)
    m = mx.score_metrics(rows, CODES, 0.5).first()
    assert m["micro_f1"] == m["macro_f1"] == m["subset_accuracy"] == m["lrap"] == 1.0 and m["hamming_loss"] == 0.0
    assert mx.threshold_search(scores, gold, CODES) == 0.6
    assert mx.threshold_search(scores, gold.where("false"), CODES) == 0.5
    report = mx.per_code_report(mx.decoded_rows(rows, 0.5, 6), CODES).collect()
    assert [(r["code"], r["support"]) for r in report] == [("A1", 3), ("A2", 2), ("B1", 2)]


def test_ranking_ties_take_the_worst_rank(spark):
    gold = spark.createDataFrame([(0, ["A1"])], "row_id bigint, gold array<string>")
    rows = mx.scored_rows(gold, long_scores(spark, [[0.5, 0.5, 0.1]]))
    assert mx.score_metrics(rows, CODES, 0.5).first()["lrap"] == 0.5


def pair_rows(spark, gold, pred):
    return spark.createDataFrame([(0, gold, pred)], "row_id bigint, gold string, pred string")


def test_saved_pairs(spark):
    wrong = mx.evaluate_saved(pair_rows(spark, "A1:2", "A1:1"), CODES, "gold", "pred").first()
    assert (wrong["micro_f1"], wrong["joint_micro_f1"], wrong["gold_code_sentiment_accuracy"]) == (1.0, 0.0, 0.0)
    half = mx.evaluate_saved(pair_rows(spark, "B1:1, B1:2", "B1:1"), CODES, "gold", "pred").first()
    assert half["joint_micro_recall"] == 0.5 and half["joint_micro_f1"] == pytest.approx(2 / 3)
    assert (half["micro_f1"], half["gold_codes"], half["gold_code_sentiment_pairs"]) == (1.0, 1, 2)
    with pytest.raises(ValueError, match="line 2"):
        mx.check_labels(pair_rows(spark, "A1:9", ""), "gold")


def test_gold_conflict_is_masked(spark):
    df = spark.createDataFrame([(0, "A1:1, A1:2"), (1, "B1:0"), (2, None), (3, "Z9:1")], "row_id bigint, c string")
    got = mx.gold_targets(df, F.col("c"), None, CODES).orderBy("row_id").collect()
    assert [(r["status"], r["valid"]) for r in got] == [("conflict", False), ("ok", True), ("ok", True), ("unknown_code", True)]


def test_pair_model_decode_and_missing_pairs(spark):
    rows = [(4, "B1", [0.28, 0.42, 0.17, 0.13]), (4, "A2", [0.66, 0.04, 0.21, 0.09]), (5, "B1", [0.45, 0.05, 0.25, 0.25])]
    probs = spark.createDataFrame(rows, "row_id bigint, code string, probs array<double>")
    kept = dec.decode_sentiment(probs, 0.5).orderBy("row_id").collect()
    # Row 5 has equal chances of positive and negative: the first one counts.
    assert [(r["row_id"], r["code"], r["sentiment"]) for r in kept] == [(4, "B1", 0), (5, "B1", 1)]
    classes = spark.createDataFrame([(c,) for c in CODES], "code string")
    dense = {(r["row_id"], r["code"]): r["probs"] for r in dec.densify(probs, probs.select("row_id").distinct(), classes).collect()}
    assert len(dense) == 6 and dense[4, "A1"] == dense[5, "A2"] == [1.0, 0.0, 0.0, 0.0] and dense[4, "A2"] == rows[1][2]


def test_report_of_pairs(spark, small_codebook):
    flat = {7: [[0.2, 0.1, 0.1, 0.6], [0.97, 0.01, 0.01, 0.01], [0.4, 0.3, 0.2, 0.1]], 8: [[0.9, 0.1, 0.0, 0.0]] * 3}
    scored = spark.createDataFrame(list(flat.items()), "row_id bigint, probs array<array<double>>")
    gold = [(7, "text", "about", [("B1", 0), ("A1", 2), ("GONE", 1)]), (8, "other", "", [("A2", 1)])]
    rows = spark.createDataFrame(gold, "row_id bigint, answer string, context string, annotations array<struct<code:string,sentiment:int>>")
    got = dec.pair_prediction_report(rows, scored, small_codebook, 0.5).orderBy("row_id").collect()
    assert [r["true_code_sentiments"] for r in got] == ["A1:2, B1:0", "A2:1"]
    assert [r["predicted_code_sentiments"] for r in got] == ["A1:2, B1:0", "UNKNOWN"]
    assert [r["correct"] for r in got] == [True, False] and [r["predicted_names"] for r in got] == ["Salary; Office", ""]
    assert got[0]["top_candidates"] == "A1:0.8000:2; B1:0.6000:0; A2:0.0300:0"
    wrong = dec.pair_prediction_report(rows, scored, small_codebook, 0.5, max_labels=1).orderBy("row_id").first()
    assert wrong["predicted_code_sentiments"] == "A1:2" and not wrong["correct"]


def test_percentiles_and_one_evaluation_state(spark):
    import numpy as np

    values = [0.0, 0.25, 0.25, 1.5, 2.0625, 7.0, 7.0, 120.5]
    rows = [(i, v, "" if i % 3 else "x", i % 2 == 0, 2, 3) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "row_id bigint, latency_seconds double, llm_error string, needs_review boolean, prompt_tokens bigint, completion_tokens bigint")
    for n in range(len(values) + 1):
        stats = mx.run_statistics(df.where(F.col("row_id") < n), 2.0, 1).first()
        want = [float(np.percentile(values[:n], q)) if n else 0.0 for q in (50, 95)]
        assert [stats["latency_seconds_p50"], stats["latency_seconds_p95"]] == pytest.approx(want)
    texts = [("A1:2, B1:0", "A1:2"), ("A2:1", ""), ("", "A1:1"), ("B1:1, B1:2", "B1:2, A2:0"), ("GONE:1", "A1:0"), ("A1:0", "A1:0")]
    table = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "row_id bigint, gold string, pred string")
    pairs = mx.saved_pair_rows(table, CODES, "gold", "pred", keep=True)
    kept = pairs.where(F.size("gold_pairs") > 0)
    state = mx.Evaluation(pairs, CODES)
    row = state.statistics().first().asDict()
    parts = [mx.overall_metrics(mx.presence_rows(kept), CODES), mx.joint_metrics(kept, CODES), mx.sentiment_accuracy(kept, CODES, single=False)]
    for part in parts:
        for name, value in part.drop("n_rows").first().asDict().items():
            assert row[name] == pytest.approx(value), name
    assert (row["input_rows"], row["evaluated_rows"], row["rows_without_known_gold_codes"]) == (6, 4, 2)
    assert sorted(map(str, state.per_code().collect())) == sorted(map(str, mx.joint_report(kept, CODES).collect()))
