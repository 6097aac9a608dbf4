"""Every registered query against its SQL in DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from eventlab.catalog import ORACLES, QUERIES
from tools.check_oracle import TABLES, compare


@pytest.fixture(scope="module")
def con(data):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(data, t)}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, data, name):
    verdict, rows, _, types = compare(spark, con, name, data)
    assert verdict == "ok", verdict
    assert types == ""


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_flagship_query(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "lag_total" in df.columns
