import pytest
from pyspark.sql import functions as F

from docfields.operators import analytics
from docfields.operators.extract import extract
from docfields.operators.records import field_rows
from docfields.operators.validate import check
from docfields.sources import published, readers, writers
from docfields.streaming import jobs


def _documents(spark, start, stop):
    """Invoices whose number is malformed for every third id, and dates that fail for every fifth."""
    number = F.concat(F.lit("Invoice no: "), F.when(F.col("id") % 3 == 0, "-").otherwise("A"), F.col("id"))
    date = F.concat(F.lit("\nDate: 2024-"), F.when(F.col("id") % 5 == 0, "13").otherwise("01"), F.lit("-02"))
    return spark.range(start, stop).select(F.concat(F.lit("d"), "id").alias("doc_id"), F.concat(number, date).alias("text"))


def _rows(table):
    return sorted(map(tuple, table.drop("created_at").collect()))


@pytest.fixture(scope="module")
def rows(spark):
    return field_rows(check(extract(_documents(spark, 0, 30))), "r").cache()


def test_a_broken_rerun_leaves_the_old_rows(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    writers.append_extractions(rows, path, "r")
    before = _rows(readers.read_extractions(spark, path))
    version = published.manifest(spark, path)[0]
    broken = rows.withColumn("value", F.when(F.col("valid"), F.raise_error(F.lit("lost"))).otherwise(F.col("value")))
    with pytest.raises(Exception):
        published.publish(broken, path, "r", 0)
    # The reader sees the old run, also while the broken attempt's files lie in the table.
    assert published.manifest(spark, path)[0] == version and _rows(readers.read_extractions(spark, path)) == before
    writers.append_extractions(rows.filter("NOT valid"), path, "r")
    assert _rows(readers.read_extractions(spark, path)) == _rows(rows.filter("NOT valid"))


def test_incomplete_version_is_skipped_and_taken_versions_are_not_reused(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    writers.append_extractions(rows, path, "a")
    (tmp_path / "t" / "_manifest" / f"{2:020d}.json").write_text('{"version": 2, "entries": [')  # a writer still at work
    assert published.manifest(spark, path)[0] == 1
    assert published.publish(rows, path, "b") == 3
    assert readers.read_extractions(spark, path).count() == 2 * rows.count()


def test_counters_rank_like_the_rows(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    for run in ("a", "b", "b"):
        writers.append_extractions(rows, path, run)
    expected = [tuple(r) for r in analytics.top_failures(readers.read_extractions(spark, path)).collect()]
    ranking = published.top_failures(spark, path)
    assert [tuple(r) for r in ranking.collect()] == expected and expected
    plan = ranking._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<field_name:string,failures:bigint>" in plan and "/_data" not in plan


def test_compaction_and_vacuum_keep_every_row(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    for epoch in range(4):
        published.publish(rows.filter(F.col("request_id").substr(-1, 1) == "0123456789abcdef"[epoch]), path, "s", epoch)
    published.publish(rows, path, "other")
    before = _rows(readers.read_extractions(spark, path))
    published.compact(spark, path, "s")
    _, entries = published.manifest(spark, path)
    assert len({e["attempt"] for e in entries if e["run_id"] == "s"}) == 1
    assert _rows(readers.read_extractions(spark, path)) == before
    # An epoch republished after compaction replaces only its own rows.
    published.publish(rows.limit(0), path, "s", 1)
    expected = [r for r in before if not (r[0] in {x.request_id for x in rows.collect() if x.request_id[-1] == "1"})]
    assert len(_rows(readers.read_extractions(spark, path))) == len(before) - rows.filter(F.col("request_id").substr(-1, 1) == "1").count()
    assert published.vacuum(spark, path, keep=1)
    assert len(_rows(readers.read_extractions(spark, path))) == len(before) - rows.filter(F.col("request_id").substr(-1, 1) == "1").count()
    del expected


def test_stream_ranking_covers_all_history(spark, tmp_path):
    source, table, ranking, log = (str(tmp_path / n) for n in ("in", "table", "ranking", "log"))
    _documents(spark, 30, 60).repartition(3).write.parquet(source)
    writers.append_extractions(field_rows(check(extract(_documents(spark, 0, 30))), "before"), table, "before")
    jobs.running_failures_over_history(jobs.document_stream(spark, source, 1), table, ranking, log, "stream").awaitTermination()
    so_far = field_rows(check(extract(_documents(spark, 0, 60))), "x")
    assert _rows(jobs.latest_ranking(spark, ranking)) == _rows(analytics.top_failures(so_far))
    writers.append_extractions(field_rows(check(extract(_documents(spark, 60, 90))), "after"), table, "after")
    everything = field_rows(check(extract(_documents(spark, 0, 90))), "x")
    assert _rows(published.top_failures(spark, table)) == _rows(analytics.top_failures(everything))


def test_compaction_writes_more_files_for_more_rows(spark, rows, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    for epoch in range(4):
        published.publish(rows.repartition(4), path, "s", epoch)
    before = _rows(readers.read_extractions(spark, path))
    monkeypatch.setattr(published, "FILE_ROWS", len(before) // 3)
    published.compact(spark, path, "s")
    stored = published.read_rows(spark, path)
    assert len(stored.inputFiles()) > 1
    assert _rows(readers.read_extractions(spark, path)) == before
