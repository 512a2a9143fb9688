"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from scriptorium.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query(spark, tables, name):
    made = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(made.columns)
    relation = tables.sql(registry.ORACLE[name])
    assert sorted(relation.columns) == columns
    theirs = sorted(repr([plain(dict(zip(relation.columns, r, strict=True))[c]) for c in columns]) for r in relation.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in made.collect()) == theirs


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
