"""Every registered query against its SQL on the smallest data folder."""

import duckdb
import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries
from labelloom.plans.oracles import ORACLES
from labelloom.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for t in check.TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return db


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(ORACLES) <= set(oracle_sql()) <= set(queries()) and set(QUERIES) <= set(queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, tables, name):
    df = QUERIES[name](spark, FOLDER)
    cursor = tables.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert check.rows_of(df.columns, df.collect()) == check.rows_of(columns, cursor.fetchall())


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["split", "label", "class_name", "n", "pct"] and df.count() == 12
