"""Every registered query against its SQL on the smallest data set."""

import glob
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_queries import rows_of

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the generated tables")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return connection


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["segment", "revenue", "orders"] and df.count() == 5


@pytest.mark.parametrize("name", sorted(set(queries()) & set(oracle_sql())))
def test_query_agrees_with_sql(spark, db, name):
    df = queries()[name](spark, FOLDER)
    result = db.execute(oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, result.fetchall())
