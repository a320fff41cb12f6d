"""Every registered query against DuckDB, and the shape of its plan."""

import os
from collections import Counter

import pytest

import __spark_entry__ as registered
from docfields.plans import oracle, queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()  # fmt: skip
QUERIES = queries.all_queries()
ORACLE = oracle.all_statements()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(registered.queries()) and set(ORACLE) <= set(registered.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    table = QUERIES[name](spark, FOLDER)
    columns = sorted(table.columns)
    plan = table._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert operator not in plan
    found = Counter(map(tuple, table.select(*columns).collect()))
    result = duck.execute(ORACLE[name])
    names = [entry[0] for entry in result.description]
    assert sorted(names) == columns
    order = [names.index(column) for column in columns]
    assert found == Counter(tuple(row[i] for i in order) for row in result.fetchall())


def test_entry(spark):
    assert [r.field for r in registered.entry(spark).collect()] == ["total_amount", "invoice_number", "expiry_date"]
