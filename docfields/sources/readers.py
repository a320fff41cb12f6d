"""Readers with fixed schemas."""

from __future__ import annotations

from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from docfields import rules, schemas


def read_words(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Word table from Parquet, JSON lines or tab-separated text with a header.

    Recognised words may contain quote characters, so the text form knows no quoting.
    """
    reader = spark.read.schema(schemas.WORDS)
    if format in ("csv", "tsv"):
        return reader.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    return reader.format(format).load(path)


def read_documents(
    spark: SparkSession, path: str, format: str = "parquet", doc_id: str = "doc_id", text: str = "text",
    schema: str | StructType | None = None, options: dict[str, Any] | None = None,
) -> DataFrame:
    """Document texts; any two columns can be named as id and text.

    Parquet files carry their schema; for other formats it defaults to the two columns as strings. ``options`` go to the
    reader, such as ``header`` for text with a header.
    """
    reader = spark.read.format(format).options(**(options or {}))
    if schema is None and format not in ("parquet", "orc"):
        schema = StructType([StructField(doc_id, StringType()), StructField(text, StringType())])
    table = (reader if schema is None else reader.schema(schema)).load(path)
    return table.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))


def read_responses(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Nested responses: JSON lines, or one pretty-printed document per file with ``multi_line``."""
    return spark.read.schema(schemas.RESPONSE).json(path, multiLine=multi_line)


CORRUPT = "_corrupt_record"


def read_responses_quarantined(
    spark: SparkSession, path: str, quarantine: str, multi_line: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Nested responses, with every record that is no response set aside instead of becoming a silent null row.

    Returns the good responses and one row of counts (``responses``, ``quarantined``, ``records``: the two add up to the
    records read; blank lines are no records). The malformed records go as text to ``quarantine``, one per line. The
    input is parsed once: the parsed records are stored once, and both outputs are read from there.
    """
    from docfields.session import fresh_path

    schema = StructType([*schemas.RESPONSE.fields, StructField(CORRUPT, StringType())])
    raw = (
        spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        .json(path, multiLine=multi_line)
    )
    parsed = fresh_path(spark, "parsed-responses")
    raw.write.parquet(parsed)
    stored = spark.read.schema(schema).parquet(parsed)
    stored.filter(F.col(CORRUPT).isNotNull()).select(CORRUPT).write.mode("overwrite").text(quarantine)
    good = stored.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    counts = stored.agg(
        F.count_if(F.col(CORRUPT).isNull()).alias("responses"), F.count_if(F.col(CORRUPT).isNotNull()).alias("quarantined"),
        F.count("*").alias("records"),
    )
    return good, counts


def read_extractions(spark: SparkSession, path: str) -> DataFrame:
    """Stored field rows of all runs; an empty table if nothing was ever stored there.

    A published table is read through its newest manifest version; a table of run folders written before that as it is.
    """
    from docfields.sources import published

    if published.versions(spark, path):
        return published.read_rows(spark, path).select(*schemas.EXTRACTIONS.names)
    try:
        stored = spark.read.schema(schemas.EXTRACTIONS).parquet(path)
        return stored.select(*schemas.EXTRACTIONS.names)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.EXTRACTIONS)


def field_catalog(spark: SparkSession) -> DataFrame:
    """The catalog of canonical fields: a constant table of a few rows."""
    return spark.createDataFrame(
        [(name, kind, list(values), list(patterns)) for name, kind, values, patterns in rules.FIELD_CATALOG],
        schemas.CATALOG,
    )
