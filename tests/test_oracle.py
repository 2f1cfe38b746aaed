"""Every query with SQL runs over the smallest tables and must equal DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_file
from codeloom.plans import oracle

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["nation", "region", "events", "documents", "embeddings", "benchmark", "labels", "conversations", "part"]
SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def in_order(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    df = entry_file.queries()[name](spark, SF)
    cursor = con.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert in_order(df.columns, df.collect()) == in_order(columns, cursor.fetchall())


def test_entry(spark):
    assert entry_file.entry(spark).count() == 1
