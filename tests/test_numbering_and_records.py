"""Consecutive numbers, ranks by counting, and CSV files read in splits."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators.numbering import consecutive, first_rows, nth_largest
from codeloom.sources import csv_records, tables


def test_consecutive_numbers(spark):
    df = spark.range(1000, numPartitions=7).where("id % 3 > 0").withColumn("word", F.md5(F.col("id").cast("string")))
    got = consecutive(df, "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(len(got))) and [r.id for r in got] == [i for i in range(1000) if i % 3]
    ordered = consecutive(df, "n", [F.desc("word")]).orderBy("n").collect()
    assert [r.n for r in ordered] == list(range(len(got))) and [r.word for r in ordered] == sorted((r.word for r in got), reverse=True)
    assert consecutive(df.limit(0), "n").collect() == []
    assert "Python" not in consecutive(df, "n")._jdf.queryExecution().executedPlan().toString()


def test_first_rows(spark):
    df = spark.range(500, numPartitions=5).withColumn("word", F.md5(F.col("id").cast("string")))
    words = sorted(r.word for r in df.collect())
    for n in (0, 1, 137, 500, 900):
        assert sorted(r.word for r in first_rows(df, n, [F.asc("word")]).collect()) == words[:n]


def test_nth_largest(spark):
    rng = random.Random(1)
    values = {"a": [rng.choice([1, 2, 3, 500, 70_000, 1 << 40]) for _ in range(300)], "b": [rng.randrange(20) for _ in range(50)], "c": [0, 0, 1]}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, v bigint").repartition(4)
    for wanted in ({"a": 1, "b": 50}, {"a": 120, "b": 7, "c": 2}, {"a": 300, "c": 3}, {"b": 51}):
        got = nth_largest(df, "v", wanted, "g")
        want = {}
        for g, n in wanted.items():
            if n <= len(values[g]):
                cut = sorted(values[g], reverse=True)[n - 1]
                want[g] = (cut, sum(v > cut for v in values[g]))
        assert got == want


def test_positions_as_row_ids(spark):
    df = spark.range(100, numPartitions=4).selectExpr("id AS v")
    assert [(r.row_id, r.v) for r in tables.with_row_id(df).orderBy("row_id").collect()] == [(n, n) for n in range(100)]


def test_line_states():
    cases = [
        ("a,b", False, False), ('a,"b', False, True), ('a,"b"', False, False), ('b",c', True, False), ('b"",c', True, True), ('b"",c"', True, False),
        ('5" pipe,x', False, False), ('x,5" pipe,"y', False, True), ("", True, True), ('"', False, True), ('""', False, False), ('"""', False, True), ('a"b"c,"', False, True),
    ]
    for line, quoted, want in cases:
        assert csv_records.ends_quoted(line, quoted, ",") == want, line
    assert csv_records.ends_quoted('a;;"b', False, ";;")


def awkward_cells(rng):
    cell = rng.choice(["", "x", "a,b", 'say "hi"', "two\nlines", "\n", 'q"\n"q', "é 日本", "end\r\nof line", ",", "long " * rng.randrange(30), "plain"])
    return cell


@pytest.fixture()
def awkward_csv(tmp_path):
    rng = random.Random(7)
    path = tmp_path / "t.csv"
    rows = [[str(n), awkward_cells(rng), awkward_cells(rng), awkward_cells(rng)] for n in range(900)]
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator="\n").writerows([["id", "first", "sec\nond", "third"], *rows])
    return str(path), rows


def in_splits(spark, size, run):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        return run()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("size", ["500b", "3k", "10m"])
def test_one_file_in_many_splits(spark, awkward_csv, size):
    path, rows = awkward_csv

    def read():
        records = csv_records.csv_records(spark, path)
        return records.rdd.getNumPartitions(), tables.with_row_id(tables.read_table(spark, path)).orderBy("row_id").collect()

    parts, got = in_splits(spark, size, read)
    assert parts > 20 if size == "500b" else parts >= 1
    missing = set(tables.MISSING_TOKENS)
    assert [[r[n] for n in range(4)] for r in got] == [[None if c in missing else c for c in row] for row in rows]
    # In the order of the file, also for records over the ends of splits.
    assert [r.row_id for r in got] == list(range(900))


def test_records_over_splits_beyond_the_bound(spark, awkward_csv):
    path, rows = awkward_csv
    read = lambda bound: in_splits(spark, "500b", lambda: [r.text for r in csv_records.csv_records(spark, path, max_sent_bytes=bound).collect()])
    assert read(0) == read(1 << 20) and len(read(0)) == 901


def test_same_as_the_reader_of_whole_files(spark, awkward_csv, tmp_path):
    path, _ = awkward_csv
    tables.write_table(spark.read.options(header=True, escape='"', multiLine=True).csv(path).repartition(3), str(tmp_path / "many.csv"))
    for source in (path, str(tmp_path / "many.csv")):
        whole = spark.read.options(header=True, escape='"', multiLine=True).csv(source)
        names = whole.columns
        split = in_splits(spark, "2k", lambda: csv_records.read_csv(spark, source, names).collect())
        assert sorted(map(str, split)) == sorted(map(str, whole.collect()))


def test_a_record_longer_than_splits_and_an_open_end(spark, tmp_path):
    path = tmp_path / "long.csv"
    body = "line\n" * 2000
    path.write_text(f'a,b\n1,"{body}"\n2,x\n3,"never closed\nstill open', encoding="utf-8")
    got = in_splits(spark, "700b", lambda: csv_records.read_csv(spark, str(path), ["a", "b"]).collect())
    assert [r.a for r in got] == ["1", "2", "3"] and got[0].b == body and got[1].b == "x"
    (tmp_path / "empty.csv").write_text("a,b\n")
    assert csv_records.read_csv(spark, str(tmp_path / "empty.csv"), ["a", "b"]).collect() == []
