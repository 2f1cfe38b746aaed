"""Every operator over nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib

import pytest
from pyspark.sql import functions as F

from codeloom.llm import decontaminate, exact_dedup, licenses, ngram_join, pieces, quality, substring_dedup, token_counts, toxicity, warc
from tests.llm.conftest import LONG, PASSAGE, ROWS


def by_id(rows, key="doc_id"):
    return {r[key]: r for r in rows if r[key] is not None}


def test_exact_dedup(docs, no_docs):
    rows = exact_dedup.exact_dedup(docs).collect()
    assert len(rows) == len(ROWS)
    got = by_id(rows)
    assert [got[i].keep_id for i in (1, 2, 11, 12, 13)] == [1, 1, 13, 13, 13]
    assert got[1].group_size == 3 and got[3].group_size == 4
    # Blank text 5 has most code points of the empty ones.
    assert got[3].keep_id == got[4].keep_id == 5 and got[5].kept
    assert got[3].text_sha256 == hashlib.sha256(b"").hexdigest()
    assert sum(r.kept for r in rows) == len({r.text_sha256 for r in rows})
    assert exact_dedup.exact_dedup(no_docs).collect() == []
    kept = exact_dedup.keep_first_copies(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in rows)


def test_exact_dedup_when_digests_collide(docs):
    plain = sorted(map(str, exact_dedup.exact_dedup(docs).collect()))
    weak = exact_dedup.exact_dedup(docs, digest=lambda text: F.length(text).cast("string"))
    assert sorted(map(str, weak.collect())) == plain


def test_repeated_winner_is_kept_once(spark):
    rows = spark.createDataFrame([(7, "same"), (7, "same"), (None, "lone"), (None, "lone")], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, r.kept) for r in exact_dedup.exact_dedup(rows).collect()) == [(0, False), (0, True), (7, False), (7, True)]


def test_ngram_join(docs, no_docs):
    rows = ngram_join.similar_documents(docs).collect()
    assert len(rows) == len(ROWS)
    got = by_id(rows)
    assert [got[i].component_id for i in (1, 2, 3, 4, 5, 6, 7, 11, 12, 13)] == [1, 1, 3, 4, 5, 6, 6, 11, 11, 11]
    assert [got[i].n_shingles for i in (3, 4, 5, 11, 6)] == [0, 0, 0, 1, 30_000 - 4]
    assert {r.component_id for r in rows if r.doc_id is None} == {None}
    assert ngram_join.similar_documents(no_docs).collect() == []
    assert ngram_join.keep_representatives(docs).columns == docs.columns


def test_substring_dedup(docs, no_docs):
    rows = substring_dedup.repeated_passages(docs).collect()
    assert len(rows) == len(ROWS)
    got = by_id(rows)
    assert [(s.low, s.high) for s in got[8].spans] == [(1, 61)] and [(s.low, s.high) for s in got[9].spans] == [(3, 63)]
    assert got[9].class_id == 8 and got[8].n_links == 1
    assert [(s.low, s.high) for s in got[6].spans] == [(0, 30_000)]
    assert got[3].n_words == got[3].n_repeated == 0 and got[3].spans == [] and got[3].class_id == 3
    assert all(r.spans == [] and r.class_id is None for r in rows if r.doc_id is None)
    assert substring_dedup.repeated_passages(no_docs).collect() == []


def test_decontamination(docs, no_docs, benchmark):
    rows = decontaminate.contamination(docs, benchmark).collect()
    assert len(rows) == len(ROWS)
    got = by_id(rows)
    assert (got[8].n_hit, got[8].n_items, got[8].contaminated) == (60, 1, True)
    assert (got[1].n_hit, got[1].items_sha256) == (2, hashlib.sha256(b"2").hexdigest())
    # The item without an id marks words and is not listed.
    assert (got[11].n_hit, got[11].n_items, got[11].contaminated) == (1, 0, True)
    assert (got[6].n_hit, got[6].contaminated) == (40, False)
    assert (got[3].n_words, got[3].contaminated) == (0, False)
    assert decontaminate.contamination(no_docs, benchmark).collect() == []
    assert not any(r.contaminated for r in decontaminate.contamination(docs, benchmark.limit(0)).collect())
    in_blocks = decontaminate.contamination(docs, benchmark, block_bytes=100).collect()
    assert sorted(map(str, in_blocks)) == sorted(map(str, rows))
    clean = decontaminate.clean_documents(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == sum(not r.contaminated for r in rows)


def test_license_scan(docs, no_docs):
    rows = licenses.license_scan(docs).collect()
    assert len(rows) == len(ROWS)
    got = by_id(rows)[10]
    assert (got.n_base, got.first_word, got.last_word, got.base_labels, got.score) == (3, 2, 9, "cc-by,gpl,mit", 1.0)
    none = by_id(rows)[3]
    assert (none.n_words, none.n_base, none.first_word, none.labels, none.score) == (0, 0, None, "", 0.0)
    assert licenses.license_scan(no_docs).collect() == []


def test_long_license_template(spark):
    whole = " ".join(licenses.LONG[1].words)
    rows = spark.createDataFrame([(1, whole.upper()), (2, "source and binary forms"), (3, "Licensed under the Apache License, Version 2.0")], "doc_id bigint, text string")
    got = by_id(licenses.license_scan(rows).collect())
    assert (got[1].labels, got[1].base_labels, got[1].score) == ("bsd", "", 1.0)
    assert got[2].labels == "" and got[3].base_labels == "apache"


def test_sentencepiece(docs, no_docs):
    rows = pieces.encode(docs).collect()
    assert len(rows) == len(ROWS) and all(r.lossless for r in rows)
    assert all(r.ids == [] for r in rows if r.doc_id in (3, 4))
    again = pieces.encode(docs.repartition(5)).collect()
    assert sorted((r.doc_id or 0, r.ids) for r in again) == sorted((r.doc_id or 0, r.ids) for r in rows)
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs)).collect() if r.doc_id}
    assert back == {i: t or "" for i, t, _ in ROWS if i}
    assert by_id(rows)[8].ids != by_id(pieces.encode(docs, seed=1).collect())[8].ids
    assert pieces.encode(no_docs).collect() == []


def test_token_counts(docs, no_docs):
    rows = token_counts.token_counts(docs).collect()
    for r in rows:
        if r.doc_id in (1, 6, 14):
            assert r.n_tokens == r.doc_tokens
    assert [(r.section, r.n_tokens) for r in rows if r.doc_id == 3] == [(0, 0.0)]
    assert len([r for r in rows if r.doc_id == 2]) == 2
    assert token_counts.token_counts(no_docs).collect() == []
    with pytest.raises(ValueError):
        token_counts.token_counts(docs, rule="none")


def test_trained_scores(docs, no_docs, labels):
    for found in (quality.quality_scores(docs, labels), toxicity.toxicity_scores(docs, labels)):
        rows = found.collect()
        assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
        assert all(r.held_out is not None for r in rows)
    assert quality.quality_scores(no_docs, labels).collect() == [] and toxicity.toxicity_scores(no_docs, labels).collect() == []
    # Without labels of both classes nothing is rejected and nothing is toxic.
    assert {r.predicted for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {1}
    assert {r.predicted for r in toxicity.toxicity_scores(docs, labels.limit(0)).collect()} == {0}
    assert quality.accepted(docs, labels).columns == docs.columns


def test_warc(spark, tmp_path):
    body = "<p>" + "x" * 200
    pages = spark.createDataFrame(
        [(3, "http://a/1", body, 1), (1, "http://a/2\r\nX: y", body, 1), (1, None, body, 1), (None, "u", body, 1), (4, "u", None, 1), (5, "u", "", 1), (6, "é", "short", 1)],
        "page_id bigint, url string, html string, header int",
    )
    warc.write_archive(pages, str(tmp_path / "a"))
    records = warc.read_archive(spark, str(tmp_path / "a"))
    rows = warc.parsed(records).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in rows) == [
        (0, "revisit", 1), (1, "response", 0), (1, "revisit", 1), (3, "revisit", 1), (4, "response", 0), (5, "response", 0), (6, "response", 0)
    ]
    for r in warc.record_bytes(records).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        size = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
        assert rest[size:] == b"\r\n\r\n" and head.startswith(b"WARC/1.1\r\n")
    assert spark.read.parquet(str(tmp_path / "a" / "payloads")).count() == 3
    warc.write_archive(pages.limit(0), str(tmp_path / "b"))
    assert warc.read_archive(spark, str(tmp_path / "b")).collect() == []


def test_damaged_payload_is_found(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([(1, "u", "good")], "page_id bigint, url string, html string"), str(tmp_path / "a"))
    stored = spark.read.parquet(str(tmp_path / "a" / "payloads")).collect()[0]
    spark.createDataFrame([(stored.digest, bytearray(b"evil"))], "digest string, payload binary").write.mode("overwrite").parquet(str(tmp_path / "a" / "payloads"))
    with pytest.raises(Exception, match="Damaged payload"):
        warc.read_archive(spark, str(tmp_path / "a")).collect()


def test_constants_of_the_fixture():
    assert len(LONG.split()) == 30_000 and len(PASSAGE.split()) == 60
