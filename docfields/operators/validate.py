"""Checks over extracted fields.

``check`` adds one boolean column per field that a check can blame. A NULL or empty input means that the check
is skipped, so the flags are never NULL. Message texts are built from the flags only where they are wanted.
Only the due-date check warns, all others report errors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields import rules
from docfields.functions.amounts import (
    amount_text, are_short, difference_text, exceeds, fraction_length, normalize_amount, short_difference, sum_difference,
)
from docfields.functions.dates import normalize_date
from docfields.functions.text import match_pattern, quoted
from docfields.schemas import MESSAGE

FORMAT_FIELDS = tuple(name for name, _ in rules.FORMAT_RULES)
# Fields that a check can blame, in reporting order.
ERROR_FIELDS = FORMAT_FIELDS + ("total_amount", "expiry_date")
WARNING_FIELDS = ("due_date",)
CHECKED_FIELDS = FORMAT_FIELDS + ("total_amount", "due_date", "expiry_date")


def flag_column(field: str) -> str:
    return f"bad_{field}"


def breaks_format(field: str, value: Column) -> Column:
    """Whether a value breaks the format rule of its field; NULL for no value."""
    return (value != "") & ~value.rlike(match_pattern(dict(rules.FORMAT_RULES)[field]))


def total_difference(subtotal: Column, tax: Column, total: Column) -> Column:
    """Absolute difference between subtotal plus tax and total (see ``sum_difference``); NULL unless all are numbers."""
    return sum_difference(normalize_amount(subtotal), normalize_amount(tax), normalize_amount(total))


def breaks_totals(subtotal: Column, tax: Column, total: Column, tolerance: str) -> Column:
    """Whether the totals differ by more than the tolerance; exactly on it passes.

    Short amounts, nearly all there are, are compared as decimals; only others take the path for any number of digits.
    """
    amounts = (subtotal, tax, total)
    limit = F.lit(tolerance).cast("decimal(17,2)")
    return F.when(are_short(*amounts), short_difference(*amounts) > limit).otherwise(
        exceeds(total_difference(*amounts), tolerance)
    )


def is_earlier(date: Column, other: Column) -> Column:
    """Whether one date text lies before another; NULL unless both are dates."""
    return normalize_date(date) < normalize_date(other)


def check(extracted: DataFrame, tolerance: str = rules.TOTAL_TOLERANCE) -> DataFrame:
    """Add one flag per checked field: true if a check blames it."""
    flags = {field: breaks_format(field, F.col(field)) for field in FORMAT_FIELDS}
    flags["total_amount"] = breaks_totals(
        F.col("subtotal_amount"), F.col("tax_amount"), F.col("total_amount"), tolerance
    )
    flags["due_date"] = is_earlier(F.col("due_date"), F.col("invoice_date"))
    flags["expiry_date"] = is_earlier(F.col("expiry_date"), F.col("birth_date"))
    return extracted.withColumns(
        {flag_column(field): F.coalesce(flag, F.lit(False)) for field, flag in flags.items()}
    )


def _totals_text() -> Column:
    amounts = [F.col(field) for field in rules.AMOUNT_FIELDS]
    digits = F.greatest(*[fraction_length(amount) for amount in amounts])
    subtotal, tax, total = (amount_text(amount) for amount in amounts)
    return F.concat(
        F.lit("subtotal ("), subtotal, F.lit(") + tax ("), tax, F.lit(") != total ("), total,
        F.lit("); diff="), difference_text(total_difference(*amounts), digits),
    )


def message(field: str) -> Column:
    """The message about a field of a checked table, NULL if there is nothing to report."""
    if field in FORMAT_FIELDS:
        text = F.concat(F.lit(rules.FORMAT_MESSAGE), quoted(F.col(field)))
    elif field == "total_amount":
        text = _totals_text()
    else:
        text = F.lit(rules.DUE_DATE_MESSAGE if field == "due_date" else rules.EXPIRY_MESSAGE)
    level = rules.WARNING if field in WARNING_FIELDS else rules.ERROR
    entry = F.struct(F.lit(field).alias("field"), text.alias("message"), F.lit(level).alias("level"))
    return F.when(F.col(flag_column(field)), entry)


def field_is_valid(field: str) -> Column:
    """Whether no error blames the field of a checked table."""
    return ~F.col(flag_column(field)) if field in ERROR_FIELDS else F.lit(True)


def document_is_valid() -> Column:
    """Whether a document of a checked table has no error; warnings do not count."""
    valid = field_is_valid(ERROR_FIELDS[0])
    for field in ERROR_FIELDS[1:]:
        valid = valid & field_is_valid(field)
    return valid


def _gather(fields: tuple[str, ...]) -> Column:
    none = F.array().cast(f"array<{MESSAGE.simpleString()}>")
    return F.concat(
        *[F.when(F.col(flag_column(field)), F.array(message(field))).otherwise(none) for field in fields]
    )


def summarize(checked: DataFrame) -> DataFrame:
    """Turn the flags into ``errors``, ``warnings`` and ``is_valid``."""
    summary = {
        "errors": _gather(ERROR_FIELDS), "warnings": _gather(WARNING_FIELDS), "is_valid": document_is_valid()
    }
    return checked.withColumns(summary).drop(*[flag_column(field) for field in CHECKED_FIELDS])


def messages(checked: DataFrame, *keys: str) -> DataFrame:
    """One row per message, numbered in reporting order: format rules first, then cross-field checks."""
    entries = F.array(*[message(field) for field in CHECKED_FIELDS])
    return (
        checked.select(*(keys or ("doc_id",)), F.posexplode(entries).alias("rule", "entry"))
        .filter(F.col("entry").isNotNull())
        .select(*(keys or ("doc_id",)), "rule", "entry.*")
    )


def split_by_level(found: Column) -> tuple[Column, Column]:
    """Errors and warnings of a message array."""
    return (
        F.filter(found, lambda m: m["level"] == rules.ERROR),
        F.filter(found, lambda m: m["level"] == rules.WARNING),
    )
