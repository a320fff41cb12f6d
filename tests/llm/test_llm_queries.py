"""The registered queries of this subpackage against DuckDB, and their shape where SQL has none."""

import os
from collections import Counter

import pytest

from docfields.llm import oracle, queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
STATEMENTS = oracle.all_statements()
ROWS_OF = {"op7_warc_archives": "pages"}


@pytest.mark.parametrize("name", STATEMENTS)
def test_query_equals_statement(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    found = queries.all_queries()[name](spark, FOLDER)
    result = connection.execute(STATEMENTS[name])
    columns = [entry[0] for entry in result.description]
    assert sorted(columns) == sorted(found.columns)
    assert Counter(map(tuple, found.select(*columns).collect())) == Counter(result.fetchall())


@pytest.mark.parametrize(
    "name", ["op2_minhash_near_dedup", "op3_secret_scan", "op9_toxicity", "op10_language_id", "op11_merkle_manifest",
             "op13_quality_classifier"],
)
def test_one_row_for_each_document(spark, name):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = queries.all_queries()[name](spark, FOLDER)
    assert Counter(r[0] for r in found.select("doc_id").collect()) == Counter(r[0] for r in documents.select("doc_id").collect())


def test_all_thirteen_and_the_pipeline_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}_" for n in range(1, 14)} == {name.split("_")[0] + "_" for name in names if name.startswith("op")}
    assert "pipeline" in names
