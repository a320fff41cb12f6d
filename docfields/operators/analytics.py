"""Rankings and counters over stored field rows and checked documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfields import rules
from docfields.operators.validate import ERROR_FIELDS, flag_column


# Bits of a long without its sign.
_BITS = 63


def top_failures(rows: DataFrame, limit: int = rules.TOP_FAILURES_LIMIT) -> DataFrame:
    """The fields that fail most often; ties go by name."""
    return (
        rows.filter(~F.col("valid")).groupBy("field_name").agg(F.count("*").alias("failures"))
        .orderBy(F.desc("failures"), "field_name").limit(limit)
        .withColumnRenamed("field_name", "field")
    )


def recurrent_failures(rows: DataFrame) -> DataFrame:
    """The ten fields with the most failures."""
    return top_failures(rows, rules.RECURRENT_LIMIT).withColumnRenamed("field", "field_name")


def low_accuracy_values(
    rows: DataFrame, field: str = "vendor_name", threshold: float = rules.ACCURACY_THRESHOLD
) -> DataFrame:
    """Values of a field whose rows are valid less often than the threshold."""
    return (
        rows.filter(F.col("field_name") == field).groupBy("value")
        .agg(F.count("*").alias("total"), F.avg(F.col("valid").cast("int")).alias("accuracy"))
        .filter(F.col("accuracy") < threshold)
    )


def stored_by_validity(rows: DataFrame) -> DataFrame:
    """Rows, different requests and stamped rows of every (field, validity) of a stored table.

    The pairs are numbered, and a request becomes one row with a bit for each of its pairs, so requests and not their
    many rows are shuffled; of requests with the same bits only the number goes on.
    """
    counted = rows.groupBy("field_name", "valid").agg(F.count("*").alias("stored"), F.count("created_at").alias("stamped"))
    place = F.row_number().over(Window.orderBy("field_name", "valid")) - 1
    numbered = counted.withColumn("place", place).select(
        "*", F.floor(F.col("place") / _BITS).alias("word"), F.expr(f"shiftleft(1L, cast(place % {_BITS} AS int))").alias("bit")
    )
    pairs = F.broadcast(numbered.select(F.col("field_name").alias("f"), F.col("valid").alias("v"), "word", "bit"))
    same = F.col("field_name").eqNullSafe(F.col("f")) & F.col("valid").eqNullSafe(F.col("v"))
    requests = rows.filter(F.col("request_id").isNotNull()).join(pairs, same).groupBy("request_id", "word").agg(F.bit_or("bit").alias("bits"))
    alike = requests.groupBy("word", "bits").agg(F.count("*").alias("n")).select(F.col("word").alias("w"), "bits", "n")
    held = (F.col("word") == F.col("w")) & (F.col("bits").bitwiseAND(F.col("bit")) != 0)
    return (
        numbered.join(alike, held, "left").groupBy("field_name", "valid", "stored", "stamped")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("requests"))
        .select("field_name", "valid", "stored", "requests", "stamped")
    )


def documents_by_type(extracted: DataFrame) -> DataFrame:
    """Number of documents of every type."""
    return extracted.groupBy("doc_type").agg(F.count("*").alias("documents"))


def errors_by_field(checked: DataFrame) -> DataFrame:
    """Number of errors (warnings excluded) per blamed field."""
    blamed = F.array(*[F.when(F.col(flag_column(field)), field) for field in ERROR_FIELDS])
    return (
        checked.select(F.explode(blamed).alias("field")).filter(F.col("field").isNotNull())
        .groupBy("field").agg(F.count("*").alias("errors"))
    )


def histogram(
    table: DataFrame, column: str, bounds: tuple[float, ...] = rules.LATENCY_BOUNDS_MS, summed: Column | None = None
) -> DataFrame:
    """Cumulative buckets of a numeric column with the sum and number of its values.

    ``summed`` may name an exact form of the value for the sum; the buckets compare the value itself.

    One pass and one row of counters, which is then turned into one row per upper bound (``+Inf`` last).
    """
    return buckets(histogram_counters(table, column, bounds, summed), bounds)


def histogram_counters(
    table: DataFrame, column: str, bounds: tuple[float, ...] = rules.LATENCY_BOUNDS_MS, summed: Column | None = None
) -> DataFrame:
    """One row of counters: values at or below each bound (``b0``...), their number and sum. Counters of parts add up,
    so a stream keeps them as its state."""
    value = F.col(column)
    return table.agg(
        *[F.count_if(value <= bound).alias(f"b{i}") for i, bound in enumerate(bounds)],
        F.count(value).alias("observations"),
        F.sum(value if summed is None else summed).alias("total"),
    )


def buckets(counters: DataFrame, bounds: tuple[float, ...] = rules.LATENCY_BOUNDS_MS) -> DataFrame:
    """The counters as one row per upper bound (``+Inf`` last)."""
    listed = [F.struct(F.lit(str(bound)).alias("le"), F.col(f"b{i}").alias("bucket")) for i, bound in enumerate(bounds)]
    listed.append(F.struct(F.lit("+Inf").alias("le"), F.col("observations").alias("bucket")))
    return counters.select(F.inline(F.array(*listed)), F.col("observations"), F.coalesce("total", F.lit(0)).alias("total"))


def field_coverage(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Number of stored values for every field of the catalog, fields never extracted included.

    Every document has a type, so ``document_type`` counts documents. Names outside the catalog are dropped before they are
    counted, which bounds what is broadcast by the size of the catalog.
    """
    known = F.col("field_name").isin([name for name, *_ in rules.FIELD_CATALOG])
    counted = rows.filter(known).groupBy("field_name").agg(F.count("*").alias("extracted"))
    typed = rows.filter(F.col("doc_type").isNotNull()).agg(F.count_distinct("request_id").alias("extracted"))
    every = counted.unionByName(typed.select(F.lit("document_type").alias("field_name"), "extracted"))
    return catalog.join(F.broadcast(every), catalog["name"] == every["field_name"], "left").select(
        "name", "type", F.coalesce("extracted", F.lit(0)).alias("extracted")
    )
