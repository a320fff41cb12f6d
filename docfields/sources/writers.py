"""Writers. A repeated run replaces its own output and leaves that of other runs alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.operators import evaluate
from docfields.sources import published
from docfields.schemas import SAMPLE_RECORD


def append_extractions(rows: DataFrame, path: str, run_id: str) -> None:
    """Add the field rows of one run to the stored table; no rows add nothing.

    The run is written to an attempt folder of its own and then published in one step (``sources.published``), so a
    retry cannot store its rows twice and a broken rerun leaves the earlier rows in place. A batch run is one epoch;
    streams have many.
    """
    published.publish(rows, path, run_id, 0)


# Word tables and page results repeat their names and ids in every line, so text forms are stored compressed; a compressed
# file is read by one task, so its number of records is bounded.
_TEXT_CODEC = "gzip"
FILE_RECORDS = 1_000_000


def write_words(words: DataFrame, path: str, form: str = "parquet") -> None:
    """A word table as Parquet or JSON lines, compressed, in files of at most ``FILE_RECORDS`` words."""
    codec = "zstd" if form == "parquet" else _TEXT_CODEC
    words.write.mode("overwrite").option("compression", codec).option("maxRecordsPerFile", FILE_RECORDS).format(form).save(path)


def write_responses(nested: DataFrame, path: str) -> None:
    """Nested responses as JSON lines."""
    nested.write.mode("overwrite").json(path)


def write_ocr_results(results: DataFrame, path: str) -> None:
    """Nested page results as compressed JSON lines, in files of at most ``FILE_RECORDS`` pages."""
    results.write.mode("overwrite").option("compression", _TEXT_CODEC).option("maxRecordsPerFile", FILE_RECORDS).json(path)


def write_evaluation(spark: SparkSession, records: DataFrame, path: str) -> None:
    """Evaluation results as JSON lines: per-document records, per-field metrics, and micro metrics with the number of records.

    The records are written, then read and parsed once: one aggregation counts the outcomes per field and the records
    together (at most one row per field and one for the records), which are stored; both reports come from those rows.
    """
    from docfields.session import fresh_path

    records.write.mode("overwrite").json(f"{path}/samples")
    stored = spark.read.schema(SAMPLE_RECORD).json(f"{path}/samples")
    judged = F.transform(F.map_entries("fields"), lambda e: F.struct(e["key"].alias("name"), e["value"]["status"].alias("status")))
    sample = F.struct(F.lit(None).cast("string").alias("name"), F.lit("sample").alias("status"))
    outcomes = stored.select(F.inline(F.concat(F.array(sample), F.coalesce(judged, F.array().cast("array<struct<name:string,status:string>>")))))
    counted_path = fresh_path(spark, "evaluation-counts")
    status = F.col("status")
    outcomes.groupBy("name").agg(
        F.count_if(status == "tp").alias("tp"), F.count_if(status.isin("wrong", "spurious")).alias("fp"),
        F.count_if(status.isin("wrong", "missed")).alias("fn"), F.count_if(status == "sample").alias("n_samples"),
    ).write.parquet(counted_path)
    counted = spark.read.parquet(counted_path)
    counts = counted.filter(F.col("name").isNotNull()).drop("n_samples")
    evaluate.report(counts).write.mode("overwrite").json(f"{path}/per_field")
    samples = counted.filter(F.col("name").isNull()).select("n_samples").scalar().alias("n_samples")
    micro = evaluate.rounded(evaluate.micro_metrics(counts)).select(samples, "*")
    micro.write.mode("overwrite").json(f"{path}/micro")
