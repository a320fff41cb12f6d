"""Documents as a stream, with the expressions of the batch jobs."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docfields import rules, schemas
from docfields.operators.analytics import buckets, documents_by_type, errors_by_field, histogram_counters
from docfields.operators.extract import extract
from docfields.operators.records import field_rows
from docfields.sources import published
from docfields.operators.validate import check

# Arguments of the trigger. This one takes what has arrived and stops; ``{"processingTime": "1 minute"}`` goes on.
Trigger = dict[str, Any]
BACKLOG: Trigger = {"availableNow": True}


def document_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Documents (doc_id, text) as their Parquet files arrive."""
    reader = spark.readStream.schema(schemas.DOCUMENTS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def extract_and_store(
    documents: DataFrame, path: str, checkpoint: str, run_id: str, trigger: Trigger = BACKLOG, redelivery: str | None = None
) -> StreamingQuery:
    """Extract, check and append the field rows of everything that arrives to the stored table at ``path``.

    Every step is a projection, so there is no state. The rows of a micro-batch are published as (run, epoch), which a
    repeated epoch replaces in one step, so each document is stored once and batch runs may share the table.

    With ``redelivery`` (an interval such as ``"7 days"``), a document whose id arrived before within that time, in the same
    file, another file or an earlier epoch, is dropped before extraction. The state is one key per id, kept until the
    interval after its arrival has passed (the watermark runs on arrival time), so it does not grow with the history.
    """
    def store(rows: DataFrame, epoch: int) -> None:
        published.publish(rows, path, run_id, epoch)

    if redelivery:
        arrived = documents.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", redelivery)
        documents = arrived.dropDuplicatesWithinWatermark(["doc_id"]).drop("_arrived")
    return (
        field_rows(check(extract(documents)), run_id).writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def _running(counts: DataFrame, path: str, checkpoint: str, trigger: Trigger, top: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Keeps the newest two states of running counters under ``path``, each in a folder named by its epoch.

    The state has one counter per name, a fixed small number, and so needs no watermark. A state is one small file.
    An epoch that is repeated after a failure overwrites its own folder; a reader that still has the state before
    the newest one open can finish.
    """
    def store(state: DataFrame, epoch: int) -> None:
        spark = state.sparkSession
        top(state).coalesce(1).write.mode("overwrite").parquet(f"{path}/{_folder(epoch)}")
        _remove(spark, path, [f"{path}/{_folder(epoch - 2)}"])

    return (
        counts.writeStream.outputMode("complete").foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def _folder(epoch: int) -> str:
    return f"state-{epoch:012d}"


def _remove(spark: SparkSession, path: str, folders: list[str]) -> None:
    files = _file_system(spark, path)
    for folder in folders:
        files.delete(_hadoop_path(spark, folder), True)


def _hadoop_path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _hadoop_path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def running_failures(
    documents: DataFrame, path: str, checkpoint: str, run_id: str, limit: int = rules.TOP_FAILURES_LIMIT,
    trigger: Trigger = BACKLOG,
) -> StreamingQuery:
    """Keep the failure ranking over all documents so far."""
    counts = (
        field_rows(check(extract(documents)), run_id).filter(~F.col("valid"))
        .groupBy(F.col("field_name").alias("field")).agg(F.count("*").alias("failures"))
    )
    return _running(counts, path, checkpoint, trigger, lambda state: state.orderBy(F.desc("failures"), "field").limit(limit))


def running_documents_by_type(documents: DataFrame, path: str, checkpoint: str, trigger: Trigger = BACKLOG) -> StreamingQuery:
    """Keep the number of documents of every type so far."""
    return _running(documents_by_type(extract(documents)), path, checkpoint, trigger, lambda state: state)


def running_errors_by_field(documents: DataFrame, path: str, checkpoint: str, trigger: Trigger = BACKLOG) -> StreamingQuery:
    """Keep the number of errors per blamed field so far."""
    return _running(errors_by_field(check(extract(documents))), path, checkpoint, trigger, lambda state: state)


def latest_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest state of running counters; an empty table before the first one.

    At most three folders are listed, and only the newest complete one is read.
    """
    files, at = _file_system(spark, path), _hadoop_path(spark, path)
    folders = [entry.getPath().toString() for entry in files.listStatus(at)] if files.exists(at) else []
    complete = sorted(f for f in folders if files.exists(_hadoop_path(spark, f"{f}/_SUCCESS")))
    return spark.read.schema(schema).parquet(complete[-1]) if complete else spark.createDataFrame([], schema)


def latest_ranking(spark: SparkSession, path: str) -> DataFrame:
    """The newest failure ranking."""
    return latest_state(spark, path, "field STRING, failures BIGINT")


def running_failures_over_history(
    documents: DataFrame, path: str, ranking: str, checkpoint: str, run_id: str, limit: int = rules.TOP_FAILURES_LIMIT,
    trigger: Trigger = BACKLOG,
) -> StreamingQuery:
    """Publish the rows of every micro-batch to the table at ``path`` and keep the ranking over all of its history.

    The state of the ranking is the table's own counters (``sources.published``): batch runs before the stream count from
    the first epoch on, and later ones as soon as they are published, since ``published.top_failures`` merges the
    counters of every published run. After each epoch the ranking is stored under ``ranking`` like the running counters.
    """
    def store(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        published.publish(rows, path, run_id, epoch)
        published.top_failures(spark, path, limit).coalesce(1).write.mode("overwrite").parquet(f"{ranking}/{_folder(epoch)}")
        _remove(spark, ranking, [f"{ranking}/{_folder(epoch - 2)}"])

    return (
        field_rows(check(extract(documents)), run_id).writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def running_histogram(
    values: DataFrame, column: str, path: str, checkpoint: str, bounds: tuple[float, ...] = rules.LATENCY_BOUNDS_MS,
    summed: Column | None = None, trigger: Trigger = BACKLOG,
) -> StreamingQuery:
    """Keep the cumulative buckets of a numeric column over everything that arrived.

    The state is one row of counters (a count per bound, the number and the sum), which Spark merges across epochs and
    partitions; after each epoch it is stored as buckets, like the other running counters.
    """
    return _running(histogram_counters(values, column, bounds, summed), path, checkpoint, trigger, lambda state: buckets(state, bounds))
