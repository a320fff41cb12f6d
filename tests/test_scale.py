"""What keeps tasks, files and micro-batches bounded when the tables grow."""

import datetime

import pytest
from pyspark.sql import functions as F

from docfields import rules
from docfields.functions import amounts
from docfields.operators import analytics, validate
from docfields.plans import queries
from docfields.sources import corpora, readers, writers


def _files(path, suffix):
    return sorted(p.name for p in path.iterdir() if p.name.startswith("part-") and p.name.endswith(suffix))


def _words(spark, n):
    return spark.range(n).select(
        F.lit("d").alias("doc_id"), F.lit("page0").alias("page_name"), F.lit(0).alias("page_index"), F.col("id").cast("int").alias("pos"),
        F.lit("word").alias("text"), F.lit(90.0).alias("conf"),
        *[F.lit(1).alias(c) for c in ("left", "top", "width", "height")],
    )


def test_stored_words_are_compressed_in_bounded_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "FILE_RECORDS", 10)
    for form, suffix in (("json", ".json.gz"), ("parquet", ".zstd.parquet")):
        writers.write_words(_words(spark, 25).coalesce(1), str(tmp_path / form), form)
        assert len(_files(tmp_path / form, suffix)) == 3
        assert readers.read_words(spark, str(tmp_path / form), form).agg(F.sum("pos")).first()[0] == 300


def test_stored_page_results_are_compressed_in_bounded_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "FILE_RECORDS", 10)
    writers.write_ocr_results(spark.range(25).coalesce(1), str(tmp_path / "t"))
    assert len(_files(tmp_path / "t", ".json.gz")) == 3
    assert spark.read.schema("id long").json(str(tmp_path / "t")).count() == 25


def test_many_rendered_documents_are_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(corpora, "TASK_DOCUMENTS", 20)
    day = datetime.datetime(2024, 1, 1)
    orders = spark.createDataFrame([(k, day) for k in range(400)] + [(None, day)], "o_orderkey long, o_orderdate timestamp")
    lines = spark.createDataFrame([(k, 10.0) for k in range(400)] + [(None, 1.0)], "l_orderkey long, l_extendedprice double")
    found = corpora.invoices(orders, lines)
    assert found.count() == 400
    sizes = [r["n"] for r in found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 8 and max(sizes) < 60
    cards = corpora.id_cards(spark.createDataFrame([(k, f"c#{k}") for k in range(400)], "c_custkey long, c_name string").coalesce(1))
    assert cards.rdd.getNumPartitions() == 20


def test_a_long_backlog_takes_few_micro_batches(spark, tmp_path):
    spark.range(100).repartition(50).write.parquet(str(tmp_path / "long"))
    spark.range(100).repartition(10).write.parquet(str(tmp_path / "short"))
    assert queries._files_per_batch(spark, str(tmp_path / "long")) in (6, 7)
    assert queries._files_per_batch(spark, str(tmp_path / "short")) == queries.STREAM_FILES


def test_short_amounts_are_compared_as_decimals_like_any_number_of_digits(spark):
    texts = ["0", "5", "5.", "5.1", "1.02", "1.03", "1.020", "0012.50", "999999999999999.99", "1000000000000000", "", "x", "1e2", "-1", "1\n", None]
    table = spark.createDataFrame([(a, b, c) for a in texts for b in texts for c in texts], "a string, b string, c string")
    columns = [F.col(c) for c in "abc"]
    exact = amounts.exceeds(validate.total_difference(*columns), "0.02")
    wrong = table.filter(~validate.breaks_totals(*columns, "0.02").eqNullSafe(exact))
    assert wrong.count() == 0
    assert table.filter(amounts.are_short(*columns)).count() == 8**3


def test_requests_of_a_field_are_counted_in_rows_of_requests(spark, monkeypatch):
    monkeypatch.setattr(analytics, "_BITS", 3)
    rows = spark.createDataFrame(
        [(f"r{i % 7}" if i % 11 else None, f"f{i % 5}" if i % 13 else None, None if i % 17 == 0 else i % 2 == 0, i if i % 3 else None) for i in range(300)],
        "request_id string, field_name string, valid boolean, created_at int",
    )
    plain = rows.groupBy("field_name", "valid").agg(
        F.count("*").alias("stored"), F.count_distinct("request_id").alias("requests"), F.count("created_at").alias("stamped")
    )
    found = analytics.stored_by_validity(rows)
    assert found.columns == plain.columns
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))
    assert "count(distinct" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def rendered(spark, monkeypatch):
    """A corpus of six documents in place of the rendered one, and how many of its rows were made."""
    made = spark.sparkContext.accumulator(0)

    def row(i):
        made.add(1)
        return (f"d{i}", "unknown", f"Invoice Number: INV-{i}", {"invoice_number": f"INV-{i}", "tax_id": None})

    schema = "doc_id string, doc_type string, text string, truth map<string,string>"
    monkeypatch.setattr(corpora, "everything", lambda s, _: s.createDataFrame(s.sparkContext.parallelize(range(6), 2).map(row), schema))
    return made


def test_batch_runs_and_stream_share_one_rendering(spark, rendered):
    found = queries.stream_and_batch(spark, "none").collect()
    assert rendered.value == 6
    assert [(r.field_name, r.stored, r.requests) for r in found] == [("invoice_number", 18, 18)]


def test_a_second_delivery_is_not_rendered_again(spark, rendered):
    assert queries.stream_redelivered(spark, "none").count() == 6
    assert rendered.value == 6


def test_repeated_values_come_from_one_pass(spark, rendered):
    found = queries.eval_pairs_repeated(spark, "none")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == len(rules.FIELD_RULES) and "array_sort(" not in plan
    assert sorted((r.doc_id, r.name, r.gt, r.pred) for r in found.collect()) == [(f"d{i}", "invoice_number", f"inv-{i}", "planted") for i in range(6)]
