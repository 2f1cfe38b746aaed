import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.operators import annotation as ann
from codeloom.operators import index
from codeloom.plans import jobs
from codeloom.sources import stores


TOPICS = {
    "A1": "salary wage income", "A2": "bonus premium reward", "B1": "office desk window",
}
FRAMES = ["the {} should change soon", "nobody talks about the {} here", "I asked twice for a better {}", "our {} got worse this year", "thanks for the {}"]


def responses(spark):
    rows = [(frame.format(word), code) for code, words in TOPICS.items() for word in words.split() for frame in FRAMES]
    rows.append(("a wage that pays for a desk by the window", "A1, B1"))
    return spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(rows)], "row_id bigint, answer string, codes string")


def test_train_and_classify(spark, small_codebook, tmp_path):
    out = str(tmp_path / "run")
    model, reports = jobs.train_text_model(responses(spark), small_codebook, "answer", "codes", out=out, max_iter=20)
    assert reports["test_metrics"].first()["micro_f1"] > 0
    loaded = stores.load_text_model(spark, f"{out}/model")
    assert loaded.classes == ["A1", "A2", "B1"] and loaded.threshold == model.threshold
    new = spark.createDataFrame([(0, "salary", "A1"), (1, "", None)], "row_id bigint, answer string, gold string")
    result = jobs.classify_with_text_model(new, loaded, small_codebook, "answer", gold_col="gold", out=str(tmp_path / "pred.parquet"))
    got = {r["row_id"]: r for r in result.collect()}
    assert "A1" in got[0]["predicted_codes"] and got[1]["predicted_codes"] == "UNKNOWN" and got[1]["needs_review"]
    stats = spark.read.json(str(tmp_path / "pred_stats.json")).first()
    assert (stats["input_rows"], stats["evaluated_rows"]) == (2, 1)


def test_index_job(spark, small_codebook, tmp_path):
    built, split = jobs.build_index_job(responses(spark), small_codebook, "answer", "codes", out=str(tmp_path / "i"), use="all")
    loaded = stores.load_index(spark, str(tmp_path / "i" / "index"))
    assert loaded.config["n_subcategory_centroids"] == 3 and split.count() == 46
    out = jobs.classify_with_index(responses(spark).limit(3).drop("codes"), loaded, "answer", threshold=0.3)
    assert all(r["predicted_codes"].startswith("A1") and r["nearest_examples"] for r in out.collect())


def test_pair_model_and_annotation(spark, small_codebook):
    model = lambda texts, descriptions: np.array([[0.25, 0.05, 0.4, 0.3] if "Salary" in d else [0.8, 0.1, 0.06, 0.04] for d in descriptions])
    df = responses(spark).limit(2)
    out = jobs.classify_with_pair_model(df, model, small_codebook, "answer").collect()
    assert {r["predicted_code_sentiments"] for r in out} == {"A1:1"}
    client = lambda system, user: {"content": '{"labels":[{"code":"A1","sentiment":1}]}'}
    gold = df.withColumn("gold", F.lit("A1:1"))
    _, stats = jobs.annotate(gold, small_codebook, client, "answer", gold_col="gold")
    assert stats.first()["joint_micro_f1"] == 1.0


def test_pair_model_against_gold(spark, small_codebook, tmp_path):
    model = lambda texts, descriptions: np.array([[0.25, 0.05, 0.4, 0.3] if "Salary" in d else [0.8, 0.1, 0.06, 0.04] for d in descriptions])
    rows = [(0, "wage", "A1", "1"), (1, "pay", "A1", "2"), (2, "desk", "A1, B1", "1, 0"), (3, "odd", "A1, A1", "1, 2"), (4, "none", None, None)]
    df = spark.createDataFrame(rows, "row_id bigint, answer string, gold string, feeling string")
    out = str(tmp_path / "p.parquet")
    jobs.classify_with_pair_model(df, model, small_codebook, "answer", out=out, gold_codes_col="gold", gold_sentiments_col="feeling")
    stats = spark.read.json(str(tmp_path / "p_stats.json")).first()
    assert (stats.input_rows, stats.evaluated_rows, stats.skipped_conflicts, stats.n_leaf_codes) == (5, 4, 1, 3)
    # Predicted is A1:1 everywhere: two hits of four, and four gold pairs.
    assert stats.joint_micro_precision == stats.joint_micro_recall == 0.5
    assert stats.pair_n_pairs == 12 and stats.pair_accuracy == 9 / 12
    by_class = {r.class_name: r for r in spark.read.csv(str(tmp_path / "p_pair_per_class.csv"), header=True, inferSchema=True).collect()}
    assert [by_class[c].support for c in ("absent", "neutral", "positive", "negative")] == [8, 1, 2, 1]
    assert sorted(r.row_id for r in spark.read.csv(str(tmp_path / "p_errors.csv"), header=True, inferSchema=True).collect()) == [1, 2, 4]
    assert spark.read.csv(str(tmp_path / "p_per_class.csv"), header=True).count() == 3
    with pytest.raises(ValueError, match="line 2"):
        jobs.classify_with_pair_model(df.withColumn("gold", F.lit("ZZ")), model, small_codebook, "answer", out=out, gold_codes_col="gold", gold_sentiments_col="feeling")


def test_reply_schema():
    schema = json.loads(ann.reply_schema(["A1"], 2))
    labels = schema["properties"]["labels"]
    assert labels["maxItems"] == 2 and labels["items"]["properties"]["code"]["enum"] == ["A1"]


def test_empty_nearest(spark):
    empty = spark.createDataFrame([], "row_id bigint, code string")
    assert index.nearest_examples(empty, empty, empty, 0).count() == 0
