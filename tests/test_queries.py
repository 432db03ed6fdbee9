"""Every registered query against its SQL counterpart, row by row."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as contract
from queries.catalog import QUERIES
from queries.oracle import ORACLE

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    db = duckdb.connect()
    for name in os.listdir(SF_DIR):
        table = name.removesuffix(".parquet")
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{name}'")
    return db


def normal(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    result = contract.queries()[name](spark, SF_DIR)
    columns = sorted(result.columns)
    got = Counter(tuple(normal(r[c]) for c in columns) for r in result.collect())
    cursor = sql.execute(contract.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert got == Counter(tuple(normal(r[p]) for p in places) for r in cursor.fetchall())


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLE)
    assert set(ORACLE) <= set(contract.oracle_sql()) <= set(contract.queries())
