from pyspark.sql import functions as F

from docfields.operators.analytics import documents_by_type, errors_by_field, top_failures
from docfields.operators.extract import extract
from docfields.operators.records import field_rows
from docfields.operators.validate import check
from docfields.sources import readers, writers
from docfields.streaming import jobs


def _documents(spark, start, stop):
    text = F.concat(F.lit("Invoice no: "), F.when(F.col("id") % 3 == 0, "-").otherwise("A"), F.col("id"))
    return spark.range(start, stop).select(F.concat(F.lit("d"), "id").alias("doc_id"), text.alias("text"))


def _rows(table):
    return sorted(map(tuple, table.drop("created_at").collect()))


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    source, sink, log = (str(tmp_path / name) for name in ("in", "out", "log"))
    ranking, ranking_log = str(tmp_path / "ranking"), str(tmp_path / "ranking-log")
    for start in (0, 30):
        _documents(spark, start, start + 30).repartition(3).write.mode("append").parquet(source)
        for _ in range(2):  # the second start finds nothing new
            jobs.extract_and_store(jobs.document_stream(spark, source, 2), sink, log, "r").awaitTermination()
            jobs.running_failures(jobs.document_stream(spark, source), ranking, ranking_log, "r").awaitTermination()
        batch = field_rows(check(extract(_documents(spark, 0, start + 30))), "r")
        assert _rows(readers.read_extractions(spark, sink)) == _rows(batch)
        assert _rows(jobs.latest_ranking(spark, ranking)) == _rows(top_failures(batch))


def test_batch_stream_and_batch_share_a_table(spark, tmp_path):
    source, table, log = (str(tmp_path / name) for name in ("in", "table", "log"))
    documents = _documents(spark, 0, 9)
    documents.write.parquet(source)

    def batch(run):
        writers.append_extractions(field_rows(check(extract(documents)), run), table, run)

    counts = []
    for step in (lambda: batch("one"), lambda: jobs.extract_and_store(
            jobs.document_stream(spark, source), table, log, "two").awaitTermination(), lambda: batch("three")):
        for _ in range(2):  # a repeated run and a stream without news add nothing
            step()
        counts.append(readers.read_extractions(spark, table).count())
    assert counts == [9, 18, 27]
    assert readers.read_extractions(spark, table).filter("created_at IS NULL").count() == 0


def test_running_counters_keep_two_states(spark, tmp_path):
    source, types, errors = (str(tmp_path / name) for name in ("in", "types", "errors"))
    assert jobs.latest_state(spark, types, "doc_type STRING, documents BIGINT").count() == 0
    for start in range(0, 40, 10):
        _documents(spark, start, start + 10).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.document_stream(spark, source)
        jobs.running_documents_by_type(stream, types, f"{types}-log").awaitTermination()
        jobs.running_errors_by_field(stream, errors, f"{errors}-log").awaitTermination()
        extracted = extract(_documents(spark, 0, start + 10))
        assert _rows(jobs.latest_state(spark, types, "doc_type STRING, documents BIGINT")) == _rows(documents_by_type(extracted))
        assert _rows(jobs.latest_state(spark, errors, "field STRING, errors BIGINT")) == _rows(errors_by_field(check(extracted)))
    assert len([p for p in (tmp_path / "types").iterdir() if p.is_dir()]) == 2


def test_trigger_is_a_parameter(spark, tmp_path):
    source, table, log = (str(tmp_path / name) for name in ("in", "table", "log"))
    _documents(spark, 0, 3).write.parquet(source)
    query = jobs.extract_and_store(jobs.document_stream(spark, source), table, log, "r", trigger={"processingTime": "0 seconds"})
    try:
        query.processAllAvailable()
        _documents(spark, 3, 6).write.mode("append").parquet(source)
        query.processAllAvailable()
        assert query.isActive and readers.read_extractions(spark, table).count() == 6
    finally:
        query.stop()
