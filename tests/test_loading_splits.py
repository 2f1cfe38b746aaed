import pytest
from pyspark.sql import functions as F

from codeloom.operators import codebook as cb
from codeloom.operators import pairs
from codeloom.operators import responses as rs
from codeloom.operators import splits
from codeloom.sources import stores, tables


def raw_codebook(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "position int, `Код` string, `Категория` string, `Подкатегория` string")


def test_codebook(spark, tmp_path):
    good = raw_codebook(spark, [("А1", "Финансы", "Зарплата"), ("A2", "Финансы", "Премии"), ("", "", ""), ("B1", "Условия труда", "Рабочее место")])
    book = cb.load_codebook(good).orderBy("order").collect()
    assert [(r["code"], r["parent_code"], r["name"]) for r in book] == [("A1", "A", "Зарплата"), ("A2", "A", "Премии"), ("B1", "B", "Рабочее место")]
    assert book[0]["description"] == "Категория: Финансы. Подкатегория: Зарплата"
    with pytest.raises(ValueError, match="inconsistent"):
        cb.load_codebook(raw_codebook(spark, [("A1", "Финансы", "x"), ("A2", "Другое название", "y")]))
    with pytest.raises(ValueError, match="invalid_leaf"):
        cb.load_codebook(raw_codebook(spark, [("AB", "x", "y")]))
    with pytest.raises(ValueError, match="empty"):
        cb.load_codebook(raw_codebook(spark, [("", "", "")]))
    path = tmp_path / "book.csv"
    path.write_text("﻿ Код ,Категория,Подкатегория\nА1,Финансы,\n", encoding="utf-8")
    assert tables.read_codebook(spark, str(path)).collect()[0].asDict() == {"Код": "А1", "Категория": "Финансы", "Подкатегория": ""}


def test_load_report(spark):
    rows = [(0, "a", "A1, B1", "2, 1"), (1, "b", "A2", "0"), (2, "c", "UNKNOWN", None), (3, "d", "A1, A1", "1, 2"), (4, " ", "A1", "1")]
    parsed = rs.parse_annotated(spark.createDataFrame(rows, "row_id bigint, t string, c string, s string"), "t", "c", "s")
    assert rs.load_report(parsed).first().asDict() == {
        "input_rows": 5, "loaded_rows": 3, "empty_text_rows": 1, "skipped_conflicting_sentiment_rows": 1,
    }
    assert [r["source_row"] for r in rs.conflict_rows(parsed).collect()] == [5]
    assert rs.usable_annotated(parsed, strict=True).count() == 3


def test_required_columns_and_rows(spark):
    df = spark.range(1)
    with pytest.raises(ValueError, match="Missing columns"):
        rs.require_columns(df, ["text"])
    with pytest.raises(ValueError):
        rs.require_rows(df.where("false"))


def wide(spark, n=40, partitions=3):
    sets = [["B1", "A2"], ["A1"], ["A2"], ["A1", "B1"], ["B1"]]
    rows = [(i, f"answer no. {i}", f"answer no. {i}", "", sets[i % 5]) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id bigint, text string, answer string, context string, codes array<string>")
    return df.withColumn("stratum", splits.stratum_of_codes(F.col("codes"))).repartition(partitions)


def test_split_contract(spark):
    first = {r["row_id"]: r["split"] for r in splits.split_train_val_test(wide(spark), 0.2, 0.2, 42).collect()}
    again = {r["row_id"]: r["split"] for r in splits.split_train_val_test(wide(spark, partitions=7), 0.2, 0.2, 42).collect()}
    assert first == again and set(first) == set(range(40))
    assert sorted(first.values()).count("test") == 8 and sorted(first.values()).count("val") == 8
    with pytest.raises(ValueError):
        splits.split_train_val_test(wide(spark), 0.6, 0.5)


def held_out(spark, sizes, size):
    """Rows held out of each stratum, and whether strata were kept apart."""
    rows = [(f"{s}{i}", s) for s, n in sizes.items() for i in range(n)]
    keys = spark.createDataFrame(rows, "row_id string, stratum string")
    holdout = splits.Holdout(keys, size, 3, True)
    marked = holdout.mark(keys, "held").where("held").groupBy("stratum").count().collect()
    return holdout.stratified, {r["stratum"]: r["count"] for r in marked}


def test_quotas(spark):
    assert held_out(spark, {"a": 10, "b": 30}, 0.1) == (True, {"a": 1, "b": 3})
    # 4 rows of 1 + 7 + 13 + 15: one each by remainder.
    assert held_out(spark, {"a": 15, "b": 7, "c": 14}, 0.1) == (True, {"a": 2, "b": 1, "c": 1})
    for sizes, size, total in (({"a": 1, "b": 30}, 0.1, 4), ({"a": 2}, 0.99, 1), ({"a": 5}, 0.0, 0), ({}, 0.5, 0)):
        stratified, found = held_out(spark, sizes, size)
        assert not stratified and sum(found.values()) == total


def test_many_strata(spark):
    """More strata than any table that a driver should hold as a literal."""
    df = spark.range(60_000).selectExpr("id AS row_id", "concat('s', id % 20000) AS stratum")
    done = splits.split_train_val_test(df, 0.0, 0.34)
    counts = done.groupBy("stratum").agg(F.count_if(F.col("split") == "test").alias("test"), F.count("*").alias("n"))
    assert counts.agg(F.min("test"), F.max("test"), F.sum("test"), F.count("*")).first()[:] == (1, 2, 20_400, 20_000)


def test_coverage_moves_one_row_for_keys_that_share_it(spark):
    rows = [
        (1, "train", ["z"]), (2, "test", ["a", "c"]), (3, "val", ["b", "c"]), (4, "val", ["c"]), (5, "test", ["a"]), (6, "val", ["d", "e"]),
        (7, "val", ["e", "f"]), (8, "test", ["f"]), (9, "val", ["z"]),
    ]
    df = spark.createDataFrame(rows, "row_id bigint, split string, codes array<string>")
    got = {r.row_id: r.split for r in splits.ensure_train_coverage(df).collect()}
    # In the order of keys: a moves 2 (and covers c), b moves 3, d moves 6 (and covers e), f moves 7.
    assert sorted(n for n, s in got.items() if s == "train") == [1, 2, 3, 6, 7]
    assert splits.ensure_train_coverage(df.where("row_id = 1")).collect()[0].split == "train"


def test_coverage_of_many_missing_keys(spark):
    df = spark.range(20_000).selectExpr("id AS row_id", "if(id < 5, 'train', 'val') AS split", "array(concat('k', id), concat('k', id + 1)) AS codes")
    done = splits.ensure_train_coverage(df.where("row_id % 2 = 0 OR row_id < 5"))
    assert done.where("split = 'train'").selectExpr("explode(codes) AS k").distinct().count() == done.selectExpr("explode(codes) AS k").distinct().count()


def test_coverage(spark):
    rows = [(0, ["A1"], "train"), (1, ["B1", "C1"], "test"), (2, ["B1"], "val"), (3, ["C1"], "test")]
    df = spark.createDataFrame(rows, "row_id bigint, codes array<string>, split string")
    moved = {r["row_id"]: r["split"] for r in splits.ensure_train_coverage(df).collect()}
    assert moved == {0: "train", 1: "train", 2: "train", 3: "test"}


def annotated(spark):
    rows = [(0, "t", "t", "", [("A1", 2), ("B1", 1)]), (1, "u", "u", "", [])]
    return spark.createDataFrame(rows, "row_id bigint, text string, answer string, context string, annotations array<struct<code:string,sentiment:int>>")


def test_pairs(spark, small_codebook):
    full = pairs.full_pairs(annotated(spark), small_codebook).orderBy("row_id", "code_position").collect()
    assert [r["label"] for r in full] == [3, 0, 2, 0, 0, 0]
    sampled = pairs.build_pairs(annotated(spark), small_codebook, 1.0, 7).collect()
    assert sum(r["row_id"] == 0 for r in sampled) == 3 and sum(r["row_id"] == 1 for r in sampled) == 1
    with pytest.raises(ValueError):
        pairs.build_pairs(annotated(spark), small_codebook, -1)


def test_stores(spark, tmp_path):
    assert stores.report_paths("/x/out.csv")["stats"] == "/x/out_stats.json"
    path = stores.write_config(spark, {"a": 1, "b": "я"}, str(tmp_path / "config"))
    assert stores.read_config(spark, path) == {"a": 1, "b": "я"}
    src = tmp_path / "in.csv"
    src.write_text('id,text\n1,"a\nb ""q"""\n2,NA\n', encoding="utf-8")
    got = [tuple(r) for r in tables.read_table(spark, str(src)).collect()]
    assert got == [("1", 'a\nb "q"'), ("2", None)]
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.xlsx")


def test_a_second_run_replaces_its_columns(spark):
    source = spark.createDataFrame([(0, "a", "old"), (1, "b", "old")], "row_id bigint, answer string, predicted_codes string")
    new = spark.createDataFrame([(0, "A1")], "row_id bigint, predicted_codes string")
    got = rs.attach(source, new)
    assert got.columns == ["row_id", "answer", "predicted_codes"] and {r.row_id: r.predicted_codes for r in got.collect()} == {0: "A1", 1: None}


def test_rows_with_known_codes(spark, small_codebook):
    df = spark.createDataFrame([(0, ["A1"]), (1, ["A1", "Z"]), (2, []), (3, ["B1", "A2"])], "row_id bigint, codes array<string>")
    assert sorted(r.row_id for r in rs.rows_with_known_codes(df, small_codebook).collect()) == [0, 2, 3]
