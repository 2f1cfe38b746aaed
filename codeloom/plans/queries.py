"""The registered queries: every operator run over whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes as cd
from ..functions import text as tx
from ..functions import vectors as vec
from ..operators import annotation as ann
from ..operators import codebook as cb
from ..operators import decode as dec
from ..operators import features as ft
from ..operators import index as ix
from ..operators import linear, mining, pairs, projection, scorers, splits
from ..operators import metrics as mx
from ..operators import responses as rs
from ..settings import fresh_path, materialize
from ..sources import stores, tables
from ..sources.ledger import Ledger
from ..streaming.scoring import score_stream
from . import jobs, views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

THRESHOLD, MAX_LABELS = 0.5, 3


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _text(array: Column | str) -> Column:
    return F.array_join(array, ",")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show; -0.0 becomes 0.0."""
    out = [F.round(c, digits) + 0.0 if t == "double" else F.col(c) for c, t in df.dtypes]
    return df.select(*[e.alias(c) for e, c in zip(out, df.columns, strict=True)])


# ---- columns and loading ---------------------------------------------------------------------


@query
def clean_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.responses(spark, sf_dir)
    return rows.select("row_id", tx.combine_text(F.col("answer"), F.col("context")).alias("text"))


@query
def semicolon_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.responses(spark, sf_dir).withColumn("cell", F.concat_ws(";", F.col("lang"), F.col("answer")))
    return rows.select("row_id", tx.after_semicolon_prefix(F.col("cell"), "about:").alias("text"))


@query
def split_codes_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.responses(spark, sf_dir).select("row_id", cd.split_codes(F.col("raw_codes")).alias("codes"))
    return rs.explode_codes(rows).select("row_id", "pos", "code", cd.parent_code(F.col("code")).alias("parent_code"))


@query
def loaded_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rs.rows_with_known_codes(views.labelled(spark, sf_dir), views.codebook(spark))
    return rows.select("row_id", "text", _text("codes").alias("codes"))


@query
def code_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = rs.explode_codes(views.labelled(spark, sf_dir).select("row_id", "codes")).select("row_id", "code")
    return cb.enrich(long, views.codebook(spark).where(F.col("code") != "B2"), "left")


@query
def unknown_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = rs.explode_codes(views.labelled(spark, sf_dir).select("row_id", "codes"))
    return cb.unknown_codes(long, views.codebook(spark).where(~F.col("code").isin("B2", "C1")))


@query
def annotations_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = rs.parse_annotated(views.responses(spark, sf_dir), "answer", "raw_codes", "raw_sentiments")
    return parsed.select("row_id", "status", *cd.annotations_to_text(F.col("annotations")))


@query
def load_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.load_report(rs.parse_annotated(views.responses(spark, sf_dir), "answer", "raw_codes", "raw_sentiments"))


@query
def conflict_source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.conflict_rows(rs.parse_annotated(views.responses(spark, sf_dir), "answer", "raw_codes", "raw_sentiments"))


@query
def inline_sentiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = cd.parse_code_sentiments(F.col("inline_labels"))
    rows = views.responses(spark, sf_dir).select("row_id", labels.alias("l"))
    return rows.select("row_id", F.col("l.status").alias("status"), _text(F.transform("l.labels", cd.pair_text)).alias("labels"))


@query
def response_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = rs.explode_codes(views.labelled(spark, sf_dir).select("row_id", "text", "codes"))
    return rs.response_groups(long).select("row_id", "text", _text("codes").alias("codes"), "stratum")


@query
def codes_per_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = rs.explode_codes(views.labelled(spark, sf_dir).select("row_id", "codes")).select("row_id", "code")
    return rs.n_codes(long)


@query
def single_label_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = views.codebook(spark).where(F.col("code") != "A2")
    return rs.single_label_corpus(views.responses(spark, sf_dir), "answer", "raw_codes", known)


# ---- codebook --------------------------------------------------------------------------------


def _parts_as_codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts read as an untidy codebook: brands as codes, types as categories, names as leaves."""
    part = views.table(spark, sf_dir, "part")
    code = F.when(F.col("p_size") == 1, F.lit(" ")).when(F.col("p_size") == 2, F.lit("brand")).otherwise(
        F.concat(F.element_at(F.split("p_name", " "), 1), F.lit(" "), F.regexp_extract("p_brand", "[0-9]+", 0))
    )
    return part.select(F.col("p_partkey").alias("position"), code.alias("Код"), F.col("p_type").alias("Категория"), F.col("p_name").alias("Подкатегория"))


@query
def codebook_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cb.validate_codebook(cb.parse_codebook(_parts_as_codebook(spark, sf_dir)))


@query
def codebook_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A codebook of the languages and sources that occur in the documents, in order of appearance."""
    docs = views.table(spark, sf_dir, "documents")
    found = docs.groupBy("lang", "source").agg(F.min("doc_id").alias("order"))
    leaves = found.select(
        "order", F.concat(F.upper("lang"), F.regexp_extract("source", "[0-9]+", 0)).alias("code"),
        F.col("source").alias("name"), F.upper("lang").alias("parent_code"), F.col("lang").alias("parent_name"),
    )
    return cb.render_codebook(leaves)


# ---- splits and pairs ------------------------------------------------------------------------


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.labelled(spark, sf_dir).withColumn("stratum", splits.stratum_of_codes(F.col("codes")))
    return splits.split_train_val_test(rows, 0.1, 0.1, 42)


@query
def split_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select("row_id", "split")


@query
def split_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.labelled(spark, sf_dir).withColumn("stratum", F.lit(""))
    return splits.split_train_val_test(rows, 0.15, 0.2, 7, stratify=False).select("row_id", "split")


@query
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_summary(rs.explode_codes(_split(spark, sf_dir).select("row_id", "split", "codes")))


@query
def split_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = _split(spark, sf_dir).select("row_id", "split")
    return splits.in_split(views.labelled(spark, sf_dir), assigned, "val").select("row_id", _text("codes").alias("codes"))


@query
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.label_distribution(_split(spark, sf_dir), views.classes(spark), views.codebook(spark))


@query
def coverage_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split by content that leaves several codes out of train, repaired."""
    split = F.when(F.array_contains("codes", "C1"), "val").when(F.array_contains("codes", "B2"), "test").when(
        F.array_contains("codes", "A4"), "val").when(F.array_contains("codes", "A2"), "test").otherwise("train")
    rows = views.labelled(spark, sf_dir).select("row_id", "codes", split.alias("split"))
    return splits.ensure_train_coverage(rows).select("row_id", "split")


@query
def pairs_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.annotated(spark, sf_dir).where(F.col("status") == "ok")
    return pairs.full_pairs(rows, views.codebook(spark)).select("row_id", "code", "code_name", "code_description", "label", "sentiment", "code_position")


def _sampled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.annotated(spark, sf_dir).where(F.col("status") == "ok")
    return pairs.build_pairs(rows, views.codebook(spark), 2.0, 42)


@query
def pairs_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampled_pairs(spark, sf_dir).select("row_id", "code", "label", "sentiment")


@query
def pair_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    sampled = _sampled_pairs(spark, sf_dir).select("row_id", "label")
    return pairs.pair_distribution(sampled.join(_split(spark, sf_dir).select("row_id", "split"), "row_id"))


@query
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(pairs.class_weights(_sampled_pairs(spark, sf_dir)))


@query
def positive_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(pairs.positive_weights(views.labelled(spark, sf_dir), views.classes(spark)))


@query
def balanced_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(pairs.balanced_weights(views.labelled(spark, sf_dir), views.classes(spark)))


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in long form; the text is the answer, so copies of a document share it."""
    rows = views.labelled(spark, sf_dir).select("row_id", F.col("answer").alias("text"), "codes")
    return rs.explode_codes(rows).select("row_id", "text", "code")


@query
def class_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.class_sizes(_long(spark, sf_dir))


@query
def positive_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mining.positive_pairs(_long(spark, sf_dir), 10, 5000, 42)
    return found.select("code", "row_a", "row_b", F.md5("text_a").alias("a"), F.md5("text_b").alias("b"), "label")


@query
def negative_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without a code, found by its position."""
    return mining.negative_candidates(_long(spark, sf_dir))


@query
def contrastive_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mining.contrastive_negatives(_long(spark, sf_dir), 10, 5000, seed=42)
    return found.select("code", "row_a", "row_b", "label", "sample_type")


@query
def triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.triplets(_long(spark, sf_dir), 10, 5000, 42).select("code", "row_a", "row_b", "row_n")


@query
def negatives_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn negatives per code against the rules: how many, distinct, from responses without the code."""
    found = contrastive_negatives(spark, sf_dir)
    held = _long(spark, sf_dir).select(F.col("row_id").alias("row_b"), "code", F.lit(1).alias("carries"))
    anchors = _long(spark, sf_dir).select(F.col("row_id").alias("row_a"), "code", F.lit(1).alias("anchored"))
    checked = found.join(anchors, ["row_a", "code"], "left").join(_owned(spark, sf_dir, held), ["row_b", "code"], "left")
    return checked.groupBy("code").agg(
        F.count("*").alias("n_pairs"), F.count_distinct("row_a", "row_b").alias("n_distinct"),
        F.count_if(F.col("anchored").isNull() | F.col("owned").isNotNull() | (F.col("row_a") == F.col("row_b"))).alias("n_wrong"),
    )


def _owned(spark: SparkSession, sf_dir: str, held: DataFrame) -> DataFrame:
    """(row, code) where every response with the same text carries the code."""
    texts = _long(spark, sf_dir).select("row_id", F.md5("text").alias("digest")).distinct()
    uses = texts.groupBy("digest").agg(F.count("*").alias("uses"))
    by_code = held.select(F.col("row_b").alias("row_id"), "code").join(texts, "row_id").groupBy("digest", "code").agg(F.count("*").alias("with_code"))
    full = by_code.join(uses, "digest").where(F.col("uses") == F.col("with_code"))
    return full.join(texts, "digest").select(F.col("row_id").alias("row_b"), "code", F.lit(1).alias("owned"))


@query
def training_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of the tables for an external trainer."""
    rows = views.annotated(spark, sf_dir).where((F.col("status") == "ok") & (F.col("answer") != ""))
    made = jobs.prepare_training_tables(rows.drop("status"), views.codebook(spark), None, 3.0, 42)
    counts = made["pair_distribution"].where(F.col("n_pairs") > 0).select(
        F.lit("pairs").alias("table_name"), F.concat_ws(":", "split", F.col("label").cast("string")).alias("part"), F.col("n_pairs").alias("n")
    )
    for name in ("positive_pairs", "negative_pairs", "triplets"):
        per_code = made[name].groupBy("code").agg(F.count("*").alias("n"))
        counts = counts.unionByName(per_code.select(F.lit(name).alias("table_name"), F.col("code").alias("part"), "n"))
    return counts


# ---- index -----------------------------------------------------------------------------------


def _exploded(df: DataFrame, key: str) -> DataFrame:
    names = [c for c in df.columns if c not in ("centroid", key)]
    opened = df.select(key, *names, F.posexplode("centroid").alias("pos", "value"))
    return _rounded(opened)


@query
def code_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(ix.code_centroids(views.examples(spark, sf_dir), views.codebook(spark)), "code")


@query
def parent_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(ix.parent_centroids(views.examples(spark, sf_dir)), "parent_code")


@query
def single_label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that also carry the code of the next vector count as multi-label where the codes differ."""
    base = views.examples(spark, sf_dir)
    extra = base.select((F.col("row_id") + 1).alias("row_id"), F.col("code").alias("second"))
    both = base.join(extra, "row_id", "left").withColumn(
        "codes", F.array_distinct(F.array_compact(F.array("code", F.when(F.col("row_id") % 2 == 0, F.col("second")))))
    )
    return _exploded(ix.single_label_centroids(both).select("code", "n_examples", "centroid"), "code")


@query
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    centroids = ix.code_centroids(views.examples(spark, sf_dir))
    return _rounded(ix.centroid_scores(views.vectors(spark, sf_dir), centroids), 4)


def _index(spark: SparkSession, sf_dir: str) -> ix.EmbeddingIndex:
    return ix.build_index(views.examples(spark, sf_dir), views.codebook(spark))


@query
def index_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.classify_by_index(views.vectors(spark, sf_dir), _index(spark, sf_dir), top_k=5, threshold=0.3, max_labels=2, nearest_k=2)


@query
def nearest_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted = views.vectors(spark, sf_dir).select("row_id", "code")
    built = _index(spark, sf_dir)
    near = ix.nearest_examples(predicted, views.vectors(spark, sf_dir), built.examples, 3)
    return _rounded(near.select("row_id", "code", "rank", "example_id", "score"), 4)


@query
def index_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stores.save_index(_index(spark, sf_dir), fresh_path(spark, "index"))
    loaded = stores.load_index(spark, path)
    checked = ix.check_index(loaded.examples, loaded.config["embedding_dim"])
    return checked.withColumns({
        "n_codes": F.lit(loaded.config["n_subcategory_centroids"]), "n_parents": F.lit(loaded.config["n_parent_centroids"]),
        "embedding_dim": F.lit(loaded.config["embedding_dim"]),
    })


@query
def hashed_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = ix.encode(views.texts(spark, sf_dir), "text")
    return encoded.select("row_id", F.size("embedding").alias("dim"), F.round(vec.l2_norm(F.col("embedding")), 3).alias("norm"))


@query
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each vector to the next one, with the input prefix of its text."""
    left = views.vectors(spark, sf_dir)
    right = left.select((F.col("row_id") - 1).alias("row_id"), F.col("embedding").alias("other"))
    similarity = vec.cosine(F.col("embedding"), F.col("other"))
    return left.join(right, "row_id").select(
        "row_id", tx.with_prefix(F.col("text"), "query: ").alias("text"), tx.compact_float(similarity).alias("similarity")
    )


# ---- decoding --------------------------------------------------------------------------------


@query
def ranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dec.rank_candidates(views.scores(spark, sf_dir), 5)


@query
def decode_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dec.decode(views.scores(spark, sf_dir), THRESHOLD, MAX_LABELS)


@query
def sentiment_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(dec.decode_sentiment(views.probabilities(spark, sf_dir), THRESHOLD, MAX_LABELS))


@query
def softmax_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors read as logits."""
    probs = vec.softmax(F.slice("embedding", 1, 4))
    rows = views.vectors(spark, sf_dir).select("row_id", F.posexplode(probs).alias("pair_class", "p"))
    return _rounded(rows.withColumn("sentiment", cd.sentiment_of_class(F.col("pair_class"))))


def _frame(gathered: DataFrame, spark: SparkSession, rules: dec.DecodeRules, **extra) -> DataFrame:
    return dec.prediction_columns(gathered, views.codebook(spark), THRESHOLD, MAX_LABELS, 4, 0.05, rules, **extra)


@query
def predictions_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = views.responses(spark, sf_dir).select("row_id", (tx.clean_text(F.col("answer")) == "").alias("blank_text"))
    gathered = dec.gather_scores(views.scores(spark, sf_dir)).join(texts, "row_id")
    return _frame(gathered, spark, dec.LINEAR_RULES, blank=F.col("blank_text"))


@query
def predictions_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_frame(dec.gather_scores(views.scores(spark, sf_dir)), spark, dec.ENCODER_RULES))


@query
def predictions_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    gathered = dec.gather_pair_scores(views.probabilities(spark, sf_dir))
    return _rounded(_frame(gathered, spark, dec.PAIR_RULES, with_sentiments=True))


@query
def prediction_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source columns next to the prediction report, ordered by row."""
    report = dec.prediction_report(views.labelled(spark, sf_dir), views.scores(spark, sf_dir), THRESHOLD, MAX_LABELS)
    source = views.responses(spark, sf_dir).select("row_id", "context", "lang")
    return rs.attach(source, report).orderBy("row_id")


# ---- metrics ---------------------------------------------------------------------------------


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mx.evaluation_mask(views.gold_codes(spark, sf_dir), F.col("gold"), F.array().cast("array<string>"), views.CODES)
    return mx.scored_rows(marked, views.scores(spark, sf_dir))


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.decoded_rows(_scored(spark, sf_dir), THRESHOLD, MAX_LABELS)


@query
def metrics_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mx.overall_metrics(_decoded(spark, sf_dir), views.CODES))


@query
def lrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mx.score_metrics(_scored(spark, sf_dir), views.CODES, THRESHOLD, MAX_LABELS))


@query
def metrics_per_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mx.per_code_report(_decoded(spark, sf_dir), views.CODES))


@query
def error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.error_rows(_decoded(spark, sf_dir)).select("row_id", _text("gold").alias("gold"), _text("pred").alias("pred"))


@query
def row_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = views.gold_codes(spark, sf_dir)
    known = [c for c in views.CODES if c not in ("A1", "A2")]
    return mx.row_accounting(mx.evaluation_mask(gold, F.col("gold"), F.array().cast("array<string>"), known, keep=True))


@query
def threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = mx.threshold_table(_scored(spark, sf_dir), views.CODES, MAX_LABELS)
    best = [mx.best_threshold(table, m).scalar() for m in ("micro_f1", "macro_f1")]
    marked = table.withColumns({"best_micro": F.col("threshold") == best[0], "best_macro": F.col("threshold") == best[1]})
    return _rounded(marked)


def _gold_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = mx.gold_targets(views.responses(spark, sf_dir), F.col("raw_codes"), F.col("raw_sentiments"), views.CODES)
    return targets.select("row_id", "gold_pairs", "status", "valid")


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = _gold_pairs(spark, sf_dir).where(F.col("status") == "ok")
    return mx.paired_rows(views.probabilities(spark, sf_dir), gold)


def _paired_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dec.accepted(F.col("ranked"), THRESHOLD, MAX_LABELS)
    as_pair = lambda c: F.struct(c["code"].alias("code"), c["sentiment"].alias("sentiment"))
    return _paired(spark, sf_dir).withColumn("pred_pairs", F.transform(kept, as_pair))


@query
def gold_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _gold_pairs(spark, sf_dir)
    return rows.select("row_id", "status", "valid", _text(F.transform("gold_pairs", cd.pair_text)).alias("gold"))


@query
def joint_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _paired_decoded(spark, sf_dir)
    presence = mx.overall_metrics(mx.presence_rows(rows), views.CODES).drop("n_rows")
    return _rounded(mx.side_by_side([mx.joint_metrics(rows, views.CODES), presence]))


@query
def sentiment_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mx.sentiment_accuracy(_paired_decoded(spark, sf_dir), views.CODES, single=True))


@query
def sentiment_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mx.sentiment_by_code(_paired_decoded(spark, sf_dir), views.CODES))


@query
def presence_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mx.threshold_table(_paired(spark, sf_dir), views.CODES, MAX_LABELS, joint=True))


def _labelled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.annotated(spark, sf_dir).where(F.col("status") == "ok")
    full = pairs.full_pairs(rows, views.codebook(spark)).select("row_id", "code", "label")
    return full.join(views.probabilities(spark, sf_dir), ["row_id", "code"])


@query
def pair_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mx.pair_metrics(_labelled_pairs(spark, sf_dir)))


@query
def pair_class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mx.pair_class_report(mx.pair_confusion(_labelled_pairs(spark, sf_dir))))


@query
def matched_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened = lambda c: F.explode(c).alias("p")
    rows = _paired_decoded(spark, sf_dir)
    gold = rows.select("row_id", opened("gold_pairs")).select("row_id", "p.code", "p.sentiment")
    pred = rows.select("row_id", opened("pred_pairs")).select("row_id", "p.code", "p.sentiment")
    return mx.matched_pairs(gold, pred)


@query
def densified_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair scores of labelled documents laid over the grid of all documents."""
    labelled_rows = views.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"))
    known = views.probabilities(spark, sf_dir).join(labelled_rows, "row_id", "left_semi")
    docs = views.texts(spark, sf_dir).select("row_id")
    dense = dec.densify(known, docs, views.classes(spark))
    return _rounded(dense.select("row_id", "code", F.element_at("probs", 1).alias("p_absent"), dec.presence(F.col("probs")).alias("presence")))


# ---- text features ---------------------------------------------------------------------------


@query
def word_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.word_terms(views.texts(spark, sf_dir)).select("row_id", "term", "tf")


@query
def char_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = ft.char_terms(views.texts(spark, sf_dir))
    return grams.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.vocabulary(ft.term_counts(views.texts(spark, sf_dir)))


@query
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = views.texts(spark, sf_dir)
    vocab = materialize(ft.with_index(ft.vocabulary(ft.term_counts(texts)), F.lit(texts.count())), "vocab")
    return _rounded(ft.tfidf(texts, vocab), 5)


@query
def multi_hot_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.multi_hot(views.labelled(spark, sf_dir), views.classes(spark).where(F.col("code") != "A1"))


def _labelled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(views.labelled(spark, sf_dir).select("row_id", F.col("answer").alias("text"), "codes"), "rows")


@query
def linear_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled_texts(spark, sf_dir)
    return _rounded(linear.score_texts(linear.cut_and_fit(rows), rows), 4)


@query
def linear_scores_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model whose weights follow from the numbers of terms and codes."""
    texts = views.texts(spark, sf_dir)
    vocab = materialize(ft.with_index(ft.vocabulary(ft.term_counts(texts)), F.lit(texts.count())), "vocab")
    codes = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(i).alias("i")) for i, c in enumerate(views.CODES)])
    weights = vocab.select("idx", F.explode(codes).alias("c")).select("c.code", "idx", (((F.col("idx") * 7 + F.col("c.i") * 13) % 21 - 10) / 10.0).alias("weight"))
    bias = spark.createDataFrame([(c, (i % 3 - 1) / 2.0) for i, c in enumerate(views.CODES)], "code string, bias double")
    model = linear.TextModel(vocab, materialize(weights, "weights"), bias, sorted(views.CODES), vocab.count())
    return _rounded(linear.score_texts(model, texts), 4)


@query
def model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature and class counts of a fitted model that was stored and loaded."""
    model = linear.fit_text_model(_labelled_texts(spark, sf_dir))
    loaded = stores.load_text_model(spark, stores.save_text_model(model, fresh_path(spark, "model")))
    return linear.model_summary(loaded).drop("n_weights")


@query
def linear_optimality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each code was fitted on, and whether the gradient of the training loss vanishes at its weights, computed anew from the tables."""
    rows = _labelled_texts(spark, sf_dir)
    return _rounded(linear.optimality(linear.cut_and_fit(rows), rows))


# ---- projection ------------------------------------------------------------------------------


@query
def projection_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = projection.projection_table(views.vectors(spark, sf_dir).select("row_id", "code", "embedding"))
    return _rounded(table, 4)


@query
def projection_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of every projection of an index: centred, uncorrelated, in order of variance; and the variance of the vectors."""
    index, parts = _index(spark, sf_dir), None
    for target in ("examples", "codes", "parents"):
        table = projection.project_index(index, target, sample_size=None)
        moments = table.agg(
            F.count("*").alias("n"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"), F.covar_pop("x", "y").alias("covariance"),
            (F.var_pop("x") >= F.var_pop("y")).alias("ordered"), (F.var_pop("x") + F.var_pop("y")).alias("kept"),
        ).select(F.lit(target).alias("target"), "*")
        parts = moments if parts is None else parts.unionByName(moments)
    whole = index.examples.select(F.posexplode("embedding").alias("i", "v")).groupBy("i").agg(F.var_pop("v").alias("v")).agg(F.sum("v").alias("total"))
    checked = parts.withColumn("total", whole.scalar()).withColumn("within", (F.col("target") != "examples") | (F.col("kept") <= F.col("total")))
    return _rounded(checked.drop("kept"), 5)


@query
def minmax_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return _rounded(projection.minmax_scale(docs, "n_chars", 960, 40, "y"))


@query
def projection_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.sample_exact(views.vectors(spark, sf_dir).select("row_id", "code"), 300, 42)


@query
def centroid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_code = projection.centroid_points(ix.code_centroids(views.examples(spark, sf_dir), views.codebook(spark)), "code")
    by_parent = projection.centroid_points(ix.parent_centroids(views.examples(spark, sf_dir)), "parent")
    return by_code.unionByName(by_parent).drop("embedding")


# ---- annotation ------------------------------------------------------------------------------


@query
def llm_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = ann.instructions(views.codebook(spark))
    requests = ann.build_requests(views.responses(spark, sf_dir), shared, "answer", "context", "about:")
    return requests.select("row_id", "filled", F.md5(F.lit(shared.system)).alias("system"), "user_prompt")


@query
def llm_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = ann.parse_replies(views.replies(spark, sf_dir), views.CODES, 4)
    return parsed.select(
        "row_id", _text(F.transform("labels", cd.pair_text)).alias("labels"), F.size("invalid").alias("n_invalid"),
        _text("invalid").alias("invalid"), "needs_review",
    )


@query
def llm_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = ann.parse_replies(views.replies(spark, sf_dir), views.CODES, 4).select("row_id", "labels", "invalid", "needs_review", "llm_error")
    return ann.annotation_columns(parsed, views.codebook(spark)).drop("confidence", "margin")


@query
def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = ann.parse_replies(views.replies(spark, sf_dir), views.CODES, 4)
    return _rounded(mx.run_statistics(parsed, 12.5, 8))


@query
def evaluate_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ann.annotation_columns(ann.parse_replies(views.replies(spark, sf_dir), views.CODES, 4), views.codebook(spark))
    saved = views.replies(spark, sf_dir).select("row_id", "gold").join(columns, "row_id")
    return _rounded(mx.evaluate_saved(saved, views.CODES, "gold", "predicted_code_sentiments"))


@query
def evaluate_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``evaluate_saved``, from a prediction table on disk; the report per code."""
    columns = ann.annotation_columns(ann.parse_replies(views.replies(spark, sf_dir), views.CODES, 4), views.codebook(spark))
    saved = views.replies(spark, sf_dir).select("row_id", "gold").join(columns, "row_id")
    path = tables.write_table(saved, fresh_path(spark, "saved"), "parquet")
    _, per_code = jobs.evaluate_saved_job(spark, path, views.codebook(spark), "gold")
    return _rounded(per_code)


def _echo_client(system: str, user: str) -> dict:
    """A client without a model: the code follows from the length of the prompt."""
    n = len(user)
    code = views.CODES[n % len(views.CODES)]
    return {"content": '{"labels":[{"code":"%s","sentiment":%d}]}' % (code, n % 3), "prompt_tokens": n, "completion_tokens": 7}


@query
def fan_out_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, _ = jobs.annotate(views.responses(spark, sf_dir), views.codebook(spark), _echo_client, "answer", "context")
    return stored.select("row_id", "predicted_codes", "predicted_code_sentiments", "needs_review", "llm_error", "prompt_tokens", "completion_tokens")


class _Broken(RuntimeError):
    pass


@query
def annotate_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that breaks after half of its slices, and a second one on the same ledger: the results, and how often each row was answered."""

    def break_off(done: int, n_slices: int) -> None:
        if 2 * done >= n_slices:
            raise _Broken

    rows, folder = views.responses(spark, sf_dir), fresh_path(spark, "ledger")
    slice_rows = max(1, rows.count() // 4)
    run = partial(jobs.annotate, rows, views.codebook(spark), _echo_client, "answer", "context", ledger=folder, slice_rows=slice_rows)
    try:
        run(on_slice=break_off)
    except _Broken:
        pass
    stored, _ = run()
    answered = Ledger(spark, folder).replies().groupBy("row_id").agg(F.count("*").alias("times_answered"))
    return stored.join(answered, "row_id", "left").select(
        "row_id", "predicted_codes", "predicted_code_sentiments", "needs_review", "llm_error", "prompt_tokens", "completion_tokens",
        F.coalesce("times_answered", F.lit(0)).cast("bigint").alias("times_answered"),
    )


# ---- plug-in scorers -------------------------------------------------------------------------


def _stub_multilabel(batch: list[str]) -> np.ndarray:
    """Scores without a model: they follow from the length of the text."""
    lengths = np.array([len(t) for t in batch], dtype=np.int64)[:, None]
    return ((lengths * 13 + np.arange(len(views.CODES)) * 29) % 101) / 100.0


def _stub_pairs(batch: list[str], descriptions: list[str]) -> np.ndarray:
    text = np.array([len(t) for t in batch], dtype=np.int64)
    desc = np.array([len(d) for d in descriptions], dtype=np.int64)
    s = ((text * 13 + desc * 29) % 101) / 100.0
    return np.stack([1.0 - s, s * 0.2, s * 0.5, s * 0.3], axis=1)


def _scorer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.responses(spark, sf_dir)
    return rows.select(
        "row_id", tx.combine_text(F.col("answer"), F.col("context")).alias("text"), tx.clean_text(F.col("answer")).alias("answer"),
        "context",
    )


@query
def stub_scores_multilabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scorers.score_multilabel(_scorer_rows(spark, sf_dir), _stub_multilabel, views.CODES))


@query
def stub_scores_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    probs = scorers.rescore(_scorer_rows(spark, sf_dir), views.codebook(spark), _stub_pairs)
    return _rounded(probs.select("row_id", "code", F.posexplode("probs").alias("pair_class", "p")))


@query
def rescored_codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scorer under a codebook with other names and fewer codes."""
    other = views.codebook(spark).where(F.col("parent_code") != "B").withColumn("description", F.concat("description", F.lit(" (new)")))
    scored = scorers.pair_arrays(_scorer_rows(spark, sf_dir), other, _stub_pairs)
    return _rounded(dec.decode_sentiment(dec.rank_pair_arrays(scored, scorers.pair_codes(other)), THRESHOLD, MAX_LABELS))


@query
def classified_by_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jobs.classify_with_scorer(
        views.responses(spark, sf_dir), _stub_multilabel, views.CODES, views.codebook(spark), "answer", "context", threshold=0.5,
        max_labels=3, top_k=4,
    )
    return _rounded(out.drop("answer", "raw_codes", "raw_sentiments", "inline_labels"))


# ---- streaming and stores --------------------------------------------------------------------


@query
def incremental_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents scored as a stream of files: the table is one file, or a folder of several."""
    docs = views.table(spark, sf_dir, "documents")

    def scorer(docs: DataFrame) -> DataFrame:
        rows = docs.select(F.col("doc_id").alias("row_id"), tx.clean_text(F.col("text")).alias("text")).withColumn("answer", F.col("text"))
        return scorers.score_multilabel(rows, _stub_multilabel, views.CODES)

    out = fresh_path(spark, "stream")
    # A pattern, because a stream takes a plain path for a folder.
    score_stream(spark, f"{sf_dir}/{{documents}}.parquet", f"{out}/scores", f"{out}/checkpoint", scorer, docs.schema, "*")
    return spark.read.schema(scorer(docs).schema).parquet(f"{out}/scores")


@query
def source_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers written as CSV, with line ends and quotes in their cells, and read back."""
    rows = views.responses(spark, sf_dir).select(F.col("row_id").cast("string").alias("row_key"), "context", "raw_codes", F.col("answer").alias("cell"))
    path = tables.write_table(rows, fresh_path(spark, "source") + ".csv")
    back = tables.read_table(spark, path)
    return back.select(F.col("row_key").cast("bigint").alias("row_id"), "context", "raw_codes", tx.clean_text(F.col("cell")).alias("answer"))


@query
def row_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers given by position are consecutive from 0, whatever the partitions."""
    numbered = tables.source_row(tables.with_row_id(views.table(spark, sf_dir, "events").select("event_id")))
    return numbered.agg(
        F.count("*").alias("n_rows"), F.count_distinct("row_id").alias("n_distinct"), F.min("row_id").alias("first"),
        F.max("row_id").alias("last"), F.max("source_row").alias("last_source_row"),
    )


@query
def store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated splits stored and loaded."""
    rows = views.annotated(spark, sf_dir).where((F.col("status") == "ok") & (F.col("answer") != "")).drop("status")
    staged = rows.withColumn("stratum", splits.stratum_of_annotations(F.col("annotations")))
    path = stores.save_splits(splits.split_train_val_test(staged), fresh_path(spark, "splits"))
    stored, assigned = stores.load_splits(spark, path)
    return stored.join(assigned.withColumnRenamed("split", "assigned"), "row_id").select(
        "row_id", "split", "assigned", "codes", "sentiments", "code_sentiments"
    )


@query
def source_one_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same cells from one CSV file, which is read in several splits, with the positions of its rows."""
    rows = views.responses(spark, sf_dir).select(F.col("row_id").cast("string").alias("row_key"), "context", "raw_codes", F.col("answer").alias("cell"))
    path = tables.write_table(rows.coalesce(1).sortWithinPartitions(F.col("row_key").cast("bigint")), fresh_path(spark, "source") + ".csv")
    back = tables.with_row_id(tables.read_table(spark, path))
    return back.select("row_id", F.col("row_key").cast("bigint").alias("row_key"), "context", "raw_codes", tx.clean_text(F.col("cell")).alias("answer"))


@query
def codebook_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations under their regions as a codebook, written as a file and read back."""
    nation, region = views.table(spark, sf_dir, "nation"), views.table(spark, sf_dir, "region")
    codes = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("R"), F.col("r_regionkey").cast("string"), F.lit("N"), F.col("n_nationkey").cast("string")).alias("code"),
        F.col("n_name").alias(" name "), F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("parent_code"),
        F.when(F.col("r_regionkey") > 0, F.col("r_name")).alias("parent_name"),
    )
    return tables.read_codebook(spark, tables.write_table(codes, fresh_path(spark, "codebook") + ".csv"))


@query
def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report per code as an evaluation writes it beside its predictions, read from the file."""
    columns = ann.annotation_columns(ann.parse_replies(views.replies(spark, sf_dir), views.CODES, 4), views.codebook(spark))
    saved = views.replies(spark, sf_dir).select("row_id", "gold").join(columns, "row_id")
    path = tables.write_table(saved, fresh_path(spark, "saved"), "parquet")
    out = fresh_path(spark, "reports")
    jobs.evaluate_saved_job(spark, path, views.codebook(spark), "gold", out=out)
    types = "code string, support bigint, precision double, recall double, f1 double, gold_code_sentiment_accuracy double, detected_gold_sentiment_accuracy double"
    return _rounded(spark.read.schema(types).csv(stores.report_paths(out)["per_class"], header=True))


@query
def text_model_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the configuration of a training run says of its splits, classes and features."""
    out = fresh_path(spark, "text-model")
    jobs.train_text_model(views.responses(spark, sf_dir), views.codebook(spark), "answer", "raw_codes", out=out)
    config = stores.read_config(spark, f"{out}/config")
    facts = {f"{name}_rows": n for name, n in config["split_rows"].items()} | {"n_classes": config["n_classes"], "n_features": config["n_features"], "rows_read": config["data_report"]["rows_read"]}
    return spark.createDataFrame([(name, int(n)) for name, n in facts.items()], "fact string, n bigint")


@query
def index_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of an index of the train split, from its store."""
    out = fresh_path(spark, "index-job")
    jobs.build_index_job(views.responses(spark, sf_dir), views.codebook(spark), "answer", "raw_codes", out=out)
    loaded = stores.load_index(spark, f"{out}/index")
    names = ("n_examples", "n_subcategory_centroids", "n_parent_centroids", "embedding_dim")
    return spark.createDataFrame([tuple(int(loaded.config[name]) for name in names)], ", ".join(f"{name} bigint" for name in names))


# ---- flagship --------------------------------------------------------------------------------


@query
def centroid_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids from labelled vectors, every vector classified by them, metrics against its label."""
    examples = views.examples(spark, sf_dir)
    ranked = ix.top_centroids(views.vectors(spark, sf_dir), ix.code_centroids(examples), 5)
    rounded = F.transform("ranked", lambda c: F.struct(c["code"].alias("code"), F.round(c["score"], 4).alias("score")))
    scored = ranked.select("row_id", rounded.alias("ranked")).join(
        views.vectors(spark, sf_dir).select("row_id", F.array("code").alias("gold")), "row_id"
    )
    return _rounded(mx.overall_metrics(mx.decoded_rows(scored, 0.3, 2), views.CODES))
