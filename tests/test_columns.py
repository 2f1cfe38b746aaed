import pytest
from pyspark.sql import functions as F

from codeloom.functions import codes as cd
from codeloom.functions import text as tx
from codeloom.functions import vectors as vec


def value(spark, expr, **cells):
    df = spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} string" for k in cells)) if cells else spark.range(1)
    return df.select(expr.alias("v")).first()["v"]


def test_clean_and_combine(spark):
    assert value(spark, tx.clean_text(F.col("a")), a="  x\x1f\n") == "x"
    assert value(spark, tx.clean_text(F.col("a")), a=None) == ""
    assert value(spark, tx.combine_text(F.col("a"), F.col("b")), a=" x ", b=" q ") == "Контекст: q\nОтвет: x"
    assert value(spark, tx.combine_text(F.col("a"), F.col("b")), a=" x ", b=None) == "x"


@pytest.mark.parametrize("cell,prefix,expected", [
    ("5;шум за окном", "мешает: ", "5; мешает: шум за окном"),
    ("8;", "p", "8; p"), ("no semicolon", "p", "no semicolon"), ("8; x;y", "", "8; x;y"), ("1 ; a;b", "p", "1; p a;b"),
])
def test_after_semicolon_prefix(spark, cell, prefix, expected):
    assert value(spark, tx.after_semicolon_prefix(F.col("a"), prefix), a=cell) == expected


def test_codes(spark):
    assert value(spark, cd.split_codes(F.col("a")), a="А1; B1, A1") == ["A1", "B1"]
    assert value(spark, cd.split_codes(F.col("a")), a=None) == []
    assert value(spark, cd.normalize_code(F.col("a")), a=" а 1 ") == "A1"
    assert value(spark, cd.parent_code(F.col("a")), a="ab12") == "AB"
    assert value(spark, cd.parent_code(F.col("a")), a="12") == "12"


@pytest.mark.parametrize("codes,sentiments,pairs,status", [
    ("А1, B1", "2, 0", [("A1", 2), ("B1", 0)], "ok"),
    ("A1:2; B1=positive", None, [("A1", 2), ("B1", 1)], "ok"),
    ("A1", "2.0", [("A1", 2)], "ok"),
    ("A1:2, A1:2", None, [("A1", 2)], "ok"),
    ("A1:1, A1:2", None, [], "conflict"),
    ("A1, B1", "2", [], "count_mismatch"),
    ("A1, B1", None, [], "missing_sentiment"),
    ("A1:maybe", None, [], "bad_sentiment"),
    ("UNKNOWN", "1, 2", [], "ok"),
    ("UNKNOWN, A1", "НЕГАТИВНО", [("A1", 2)], "ok"),
    (None, None, [], "ok"),
])
def test_annotations(spark, codes, sentiments, pairs, status):
    got = value(spark, cd.parse_annotations(F.col("a"), F.col("b")), a=codes, b=sentiments)
    assert ([tuple(p) for p in got["annotations"]], got["status"]) == (pairs, status)


def test_several_sentiments_per_code(spark):
    got = value(spark, cd.parse_code_sentiments(F.col("a")), a="E1:1, e1=2; UNKNOWN\nA3|0, E1:1")
    assert ([tuple(p) for p in got["labels"]], got["status"]) == ([("E1", 1), ("E1", 2), ("A3", 0)], "ok")
    assert value(spark, cd.parse_code_sentiments(F.col("a")), a="E1:4")["status"] == "bad_label"


def test_formats(spark):
    cands = F.array(F.struct(F.lit("A1").alias("code"), F.lit(0.81234).alias("score")), F.struct(F.lit("B1").alias("code"), F.lit(0.5).alias("score")))
    assert value(spark, tx.format_candidates(cands)) == "A1:0.8123; B1:0.5000"
    long = "word " * 40
    shown = value(spark, tx.shorten(F.col("a")), a=long)
    assert shown.endswith("...") and len(shown) <= 122
    groups = F.array(F.struct(F.lit("A1").alias("code"), F.array(F.lit("x  y"), F.lit("z")).alias("texts")))
    assert value(spark, tx.format_nearest(groups)) == 'A1 -> "x y" | "z"'
    with pytest.raises(ValueError):
        tx.resolve_prefix({"q": "query: "}, "q", "x")
    with pytest.raises(ValueError):
        tx.resolve_prefix({"q": "query: "}, "other")
    assert tx.resolve_prefix({"q": "query: "}, "q") == "query: "


def test_vectors(spark):
    assert value(spark, vec.l2_normalize(F.array(F.lit(3.0), F.lit(4.0)))) == pytest.approx([0.6, 0.8])
    assert value(spark, vec.l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert sum(value(spark, vec.softmax(F.array(F.lit(1000.0), F.lit(1001.0))))) == pytest.approx(1.0)
