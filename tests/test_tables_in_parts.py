"""Queries over tables that are folders of several files, as well as single files."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeloom.functions import text as tx
from codeloom.operators import features as ft
from codeloom.operators import mining
from codeloom.plans import jobs, queries


@pytest.mark.parametrize("parts", [1, 3])
def test_incremental_scored_reads_every_part(spark, tmp_path, parts):
    docs = spark.createDataFrame([(n, "x" * (n % 5), "en", "web", n % 5) for n in range(30)], "doc_id bigint, text string, lang string, source string, n_chars int")
    docs.repartition(parts, "doc_id").write.parquet(str(tmp_path / "documents.parquet"))
    scored = queries.incremental_scored(spark, str(tmp_path))
    assert scored.count() == 30 * len(queries.views.CODES)
    assert scored.select("row_id").distinct().count() == 30


def test_incremental_scored_reads_one_file(spark, tmp_path):
    docs = spark.createDataFrame([(n, "x" * n, "en", "web", n) for n in range(4)], "doc_id bigint, text string, lang string, source string, n_chars int")
    docs.toPandas().to_parquet(tmp_path / "documents.parquet")
    assert queries.incremental_scored(spark, str(tmp_path)).count() == 4 * len(queries.views.CODES)


AWKWARD = ["to be or not to be", "", None, "be be BE or", "日本語 ñandú  x\x1cy _x 12 a1", "a" * 300 + " a|b", "x", "to be", None, "\x00 a\x00 ab\x00"]


def by_columns(df):
    """Long terms by the column functions: counts of rows of one key together."""
    words = df.select("row_id", F.lit("word").alias("space"), F.explode(ft.word_ngrams(F.col("text"))).alias("term"))
    chars = df.select("row_id", F.lit("char").alias("space"), F.explode(ft.char_wb_ngrams(F.col("text"))).alias("term"))
    return Counter((r.row_id, r.space, r.term) for r in words.unionByName(chars).collect())


@pytest.mark.parametrize("batch", [1 << 18, 4])
@pytest.mark.parametrize("sent", [10, 0])
def test_terms_of_rows_equal_the_columns(spark, monkeypatch, batch, sent):
    monkeypatch.setattr(ft, "BATCH_ENTRIES", batch)
    monkeypatch.setattr(ft, "MAX_SENT_KEYS", sent)
    # Keys repeat, and some are null.
    keys = [1, 2, 3, 1, None, 4, None, 5, 6, 7]
    df = spark.createDataFrame(list(zip(keys, AWKWARD, strict=True)), "row_id bigint, text string").repartition(3)
    rows = ft.text_terms(df).collect()
    assert {(r.row_id, r.space, r.term): r.tf for r in rows} == by_columns(df) and len(rows) == len(by_columns(df))


def test_terms_of_a_row_need_no_aggregate(spark):
    df = spark.createDataFrame([(n, "to be or not") for n in range(8)], "row_id bigint, text string")
    for made in (ft.word_terms(df), ft.char_terms(df)):
        assert "Aggregate" not in made._jdf.queryExecution().executedPlan().toString()


def test_terms_with_more_characters_than_numbers(spark):
    many = [" ".join(chr(c) * 2 for c in range(0x4E00 + 2500 * n, 0x4E00 + 2500 * n + 2500)) for n in range(4)]
    many.append(" ".join(many[:2]))
    df = spark.createDataFrame(list(enumerate(many)), "row_id bigint, text string").coalesce(1)
    assert {(r.row_id, r.space, r.term): r.tf for r in ft.text_terms(df).collect()} == by_columns(df)


@pytest.mark.parametrize("most", [100_000, 3])
@pytest.mark.parametrize("batch", [10_000, 3])
def test_counts_of_parts_equal_the_columns(spark, monkeypatch, most, batch):
    monkeypatch.setattr(ft, "MAX_LOCAL_TERMS", most)
    df = spark.createDataFrame(list(enumerate(AWKWARD * 3)), "row_id bigint, text string").repartition(5)
    want = {}
    for (_, *term), n in by_columns(df).items():
        old = want.get(tuple(term), (0, 0))
        want[tuple(term)] = (old[0] + 1, old[1] + n)
    # Parts that go on over several batches.
    monkeypatch.setattr(ft, "PARTS", 1)
    monkeypatch.setattr(ft, "_part_numbers", lambda terms: np.zeros(len(terms), np.uint16))
    tables = [t for n in range(4) for t in ft._count_in_parts(iter([pa.RecordBatch.from_pydict({"text": [(t or "").lower() for t in AWKWARD[n::4]]})]))]
    whole = pa.Table.from_batches(tables).sort_by("part").combine_chunks()
    sums = [r for b in ft._add_up_parts(iter(whole.to_batches(max_chunksize=batch))) for r in b.to_pylist()]
    assert {(r["space"], r["term"]): (r["df"] * 3, r["cf"] * 3) for r in sums} == want and len(sums) == len(want)
    monkeypatch.undo()
    rows = ft.term_counts(df).collect()
    assert {(r.space, r.term): (r.df, r.cf) for r in rows} == want and len(rows) == len(want)
    # Terms are not shuffled one by one.
    assert "Aggregate" not in ft.term_counts(df)._jdf.queryExecution().executedPlan().toString()


def test_edges_are_cleaned_of_every_blank_that_the_pattern_names(spark):
    codes = [c for c in range(1, 0x11000) if not 0xD800 <= c < 0xE000]
    cells = [f"{chr(c)}a{chr(c)}b{chr(c)}" for c in codes] + [" \u3000\n\x1f", "", None, "\n a\u00a0\r\n", "\x00 a \x00"]
    df = spark.createDataFrame([(c,) for c in cells], "cell string")
    pattern = F.coalesce(F.regexp_replace("cell", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""), F.lit(""))
    assert df.where(tx.clean_text(F.col("cell")) != pattern).count() == 0
    assert df.where(F.length(tx.clean_text(F.col("cell"))) == 3).count() == 29


def test_annotation_makes_each_prompt_once_for_its_slice(spark, small_codebook, monkeypatch):
    seen = []
    real = jobs.ann.collect_replies
    monkeypatch.setattr(jobs.ann, "collect_replies", lambda requests, ledger: seen.append(requests.columns) or real(requests, ledger))
    df = spark.createDataFrame([(1, "one"), (2, " \n"), (3, None)], "row_id bigint, answer string")
    stored, _ = jobs.annotate(df, small_codebook, lambda system, user: {"content": '{"labels":[{"code":"A1","sentiment":1}]}'}, "answer")
    assert {r.row_id: r.llm_error for r in stored.collect()} == {1: "", 2: "empty_text", 3: "empty_text"}
    assert seen == [["row_id", "request_key", "filled"]]


def test_digests_of_texts_are_taken_from_the_table(spark):
    long = spark.createDataFrame([(1, "A1", " a "), (1, "B1", " a "), (2, "A1", " \u00a0"), (3, "A1", None)], "row_id bigint, code string, text string")
    plain = {tuple(r) for r in mining.digest_table(long).collect()}
    assert {r[:2] for r in plain} == {(1, "A1"), (1, "B1")}
    brought = long.withColumn("digest", mining.text_digest(F.col("text"))).drop("text")
    assert {tuple(r) for r in mining.digest_table(brought).collect()} == plain
