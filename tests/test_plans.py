"""Plans that must hold at any scale."""

import re

import pytest
from pyspark.sql import functions as F

from docfields import rules
from docfields.operators import analytics, evaluate, extract, records, tokens, validate
from docfields.sources import corpora, readers, writers


def _optimized(table):
    return table._jdf.queryExecution().optimizedPlan().toString()


def _physical(table):
    return table._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "t")
    row = [("a", "Total: 5", "x", {"total_amount": "5"})]
    spark.createDataFrame(
        row, "doc_id string, text string, doc_type_truth string, truth map<string,string>"
    ).write.parquet(path)
    return spark.read.parquet(path)


def test_patterns_run_once_and_nothing_moves(documents):
    checked = validate.check(extract.extract(documents))
    for table in (
        records.field_rows(checked, "r"),
        extract.predictions(checked),
        evaluate.pair_documents(checked),
        checked,
    ):
        assert _optimized(table).count("regexp_extract(") == len(rules.FIELD_RULES)
        assert _optimized(table).count("regexp_extract_all(") <= 1
        assert "Exchange" not in _physical(table)


def test_unused_fields_cost_nothing(documents):
    plan = _optimized(extract.extract(documents).select("doc_id", "due_date"))
    assert plan.count("regexp_extract(") == 1 and "regexp_extract_all" not in plan
    assert "ReadSchema: struct<doc_id:string,text:string>" in _physical(extract.extract(documents).select("doc_id", "due_date"))


def test_counters_combine_before_the_shuffle(documents):
    plan = _physical(analytics.top_failures(records.field_rows(validate.check(extract.extract(documents)), "r")))
    assert "partial_count" in plan and "TakeOrderedAndProject" in plan and plan.count("Exchange ") == 1


def test_stored_rows_are_pruned(spark, documents, tmp_path):
    path = str(tmp_path / "rows")
    writers.append_extractions(records.field_rows(validate.check(extract.extract(documents)), "r"), path, "r")
    stored = readers.read_extractions(spark, path)
    plan = _physical(analytics.top_failures(stored.filter(F.col("doc_type") == "invoice")))
    assert re.search(r"PartitionFilters: \[[^]]*doc_type", plan)
    assert re.search(r"PushedFilters: \[[^]]*EqualTo\(valid,false\)|PushedFilters: \[[^]]*Not\(", plan)
    assert "ReadSchema: struct<field_name:string,valid:boolean>" in plan


def test_words_move_once_and_parts_once(spark, documents):
    words = corpora.words_of(documents)
    for table in (tokens.assemble_documents(words), tokens.fingerprint_words(words), tokens.ocr_results(words)):
        assert _physical(table).count("Exchange ") == 2
        assert _physical(table).count("FileScan") == 1


def test_page_numbers_need_two_exchanges(documents):
    plan = _physical(tokens.number_pages(corpora.words_of(documents)))
    assert plan.count("Exchange ") == 2 and "SortAggregate" not in plan


def test_page_statistics_are_hashed(documents):
    plan = _physical(tokens.page_statistics(corpora.words_of(documents)))
    assert "SortAggregate" not in plan and plan.count("Exchange ") == 1


def test_values_are_folded_by_document_before_the_join(documents):
    extracted = extract.extract(documents)
    plan = _optimized(evaluate.pair_tables(corpora.truth_table(documents), extract.predictions(extracted)))
    assert plan.index("Join FullOuter") < plan.index("Aggregate [doc_id")


def test_line_items_are_summed_before_the_join(spark, tmp_path):
    orders = spark.createDataFrame([(1, None)], "o_orderkey long, o_orderdate date")
    lineitem = spark.createDataFrame([(1, 2.0)], "l_orderkey long, l_extendedprice double")
    plan = _optimized(corpora.invoices(orders, lineitem))
    assert plan.index("Join") < plan.index("Aggregate")
