"""Checked documents to stored rows and nested responses, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields import rules
from docfields.operators.validate import field_is_valid, summarize
from docfields.schemas import FIELD, TOP_FAILURES

_ROW = ("request_id", "doc_type", "field_name", "value", "confidence", "valid")


def request_id(run_id: str, doc_id: Column) -> Column:
    """Id of one document in one run. A repeated task or run must not mint a new id, so it is a digest."""
    return F.sha2(F.concat_ws("|", F.lit(run_id), doc_id), 256)


def field_rows(checked: DataFrame, run_id: str) -> DataFrame:
    """One row per extracted field with its validity, straight from the checked table.

    Gives the rows of ``flatten_responses(responses(...))`` without building the nested form in between.
    """
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("field_name"), F.col(name).alias("value"),
                F.lit(rules.CONFIDENCE[name]).alias("confidence"), field_is_valid(name).alias("valid"),
            )
            for name in rules.ALL_FIELDS
        ]
    )
    return (
        checked.select(request_id(run_id, F.col("doc_id")).alias("request_id"), "doc_type", F.inline(entries))
        .filter(F.col("value").isNotNull())
    )


def responses(
    checked: DataFrame, run_id: str, latency_ms: Column | None = None, confidence: Column | None = None
) -> DataFrame:
    """One nested response per document (``schemas.RESPONSE``); top failures are attached separately."""
    entries = F.array(
        *[
            F.struct(
                F.lit(name),
                F.struct(
                    F.col(name).alias("value"), F.lit(rules.CONFIDENCE[name]).alias("confidence"),
                    field_is_valid(name).alias("valid"),
                ).cast(FIELD),
            )
            for name in rules.ALL_FIELDS
        ]
    )
    present = F.filter(entries, lambda e: e["col2"]["value"].isNotNull())
    document = F.struct(
        "doc_type", F.col("fields"), F.struct("errors", "warnings").alias("validation_summary")
    )
    unknown = F.lit(None).cast("double")
    metrics = F.struct(
        (unknown if latency_ms is None else latency_ms).cast("double").alias("processing_time_ms"),
        (unknown if confidence is None else confidence).cast("double").alias("ocr_avg_confidence"),
    )
    return summarize(checked.withColumn("fields", F.map_from_entries(present))).select(
        request_id(run_id, F.col("doc_id")).alias("request_id"),
        F.array(document).alias("documents"),
        metrics.alias("metrics"),
        F.struct(F.lit(None).cast(TOP_FAILURES).alias("top_failures")).alias("analytics"),
    )


def flatten_responses(nested: DataFrame) -> DataFrame:
    """One row per field of every document of every response.

    A missing value becomes the text ``None``, a missing confidence 0.0, a missing flag false.
    """
    # The outer explodes infer no filter from their input, which would evaluate a computed response twice.
    documents = nested.select("request_id", F.explode_outer("documents").alias("document"))
    rows = documents.select("request_id", "document.doc_type", F.explode_outer("document.fields").alias("field_name", "payload"))
    return rows.filter(F.col("field_name").isNotNull()).select(
        "request_id", "doc_type", "field_name",
        F.coalesce(F.col("payload.value"), F.lit("None")).alias("value"),
        F.coalesce(F.col("payload.confidence"), F.lit(0.0)).alias("confidence"),
        F.coalesce(F.col("payload.valid"), F.lit(False)).alias("valid"),
    )


def stamp(rows: DataFrame) -> DataFrame:
    """Field rows with the time of their storage."""
    return rows.select(*_ROW, F.current_timestamp().alias("created_at"))


def attach_top_failures(nested: DataFrame, history: DataFrame, limit: int = rules.TOP_FAILURES_LIMIT) -> DataFrame:
    """Set the history-wide top failures on every response.

    ``history`` is the stored table after the rows of these responses were appended. The ranking has at most
    ``limit`` entries and enters as a scalar subquery: it is computed once, and nothing is joined.
    """
    from docfields.operators.analytics import top_failures

    return attach_ranking(nested, top_failures(history, limit))


def attach_ranking(nested: DataFrame, ranking: DataFrame) -> DataFrame:
    """Set a ranking (field, failures; at most a few rows) on every response, as a scalar subquery.

    With the ranking of a published table (``published.top_failures``) only its counters are read, not its rows.
    """
    listed = (
        ranking.agg(F.sort_array(F.collect_list(F.struct((-F.col("failures")).alias("rank"), "field", "failures"))).alias("r"))
        .select(F.transform("r", lambda e: F.struct(e["field"], e["failures"])).cast(TOP_FAILURES).alias("top"))
    )
    return nested.withColumn("analytics", F.struct(listed.scalar().alias("top_failures")))
