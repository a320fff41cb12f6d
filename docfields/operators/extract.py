"""Document text to fields and document type; every step is a projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields import rules
from docfields.functions.text import folded, folded_pattern, search_pattern

# Words of which one stands, regardless of case, in every match of the rule. Looking for them first is much
# cheaper than a pattern, and most texts lack most of them.
_ANCHORS: dict[str, tuple[str, ...]] = {
    "invoice_number": ("invoice",),
    "invoice_date": ("date",),
    "due_date": ("due",),
    "subtotal_amount": ("total",),
    "tax_amount": ("tax",),
    "total_amount": ("total",),
    "tax_id": ("tax",),
    "routing_number": ("routing",),
    "bank_account": ("account",),
    "id_number": ("id",),
    "expiry_date": ("expir",),
    "birth_date": ("birth", "dob"),
}

# The first alternative is the shortest and always wins, so the others can never match.
_MRZ_LINE = rules.MRZ_PATTERN.split("|")[0] + ")"


def _has(text: Column, words: tuple[str, ...]) -> Column:
    found = F.contains(text, F.lit(words[0]))
    for word in words[1:]:
        found = found | F.contains(text, F.lit(word))
    return found


def _capture(name: str, pattern: str, text: Column, lower: Column) -> Column:
    """Group 1 of the leftmost match, empty without a match.

    A value without letters is taken from the folded text, where the pattern needs no case rules.
    """
    if "A-Za-z" in pattern:
        value = F.regexp_extract(text, search_pattern(pattern), 1)
    else:
        value = F.regexp_extract(lower, folded_pattern(pattern), 1)
    return F.when(_has(lower, _ANCHORS[name]), value).otherwise("")


def _value(name: str) -> Column:
    # No rule captures an empty string, so an empty capture always means "no match".
    value = F.when(F.col(name) != "", F.col(name))
    return F.replace(value, F.lit(","), F.lit("")) if name in rules.AMOUNT_FIELDS else value


def document_type(text: Column) -> Column:
    """Type of a document, decided by plain substrings and machine-readable-zone lines."""
    lower = F.lower(text)
    return (
        F.when(_has(lower, rules.INVOICE_WORDS), "invoice")
        .when(_has(lower, rules.ID_CARD_WORDS) | text.rlike(_MRZ_LINE), "id_card")
        .when(_has(lower, rules.TAX_FORM_WORDS), "tax_form")
        .otherwise(rules.UNKNOWN_TYPE)
    )


def extract(documents: DataFrame, text: str = "text", type_column: str = "doc_type") -> DataFrame:
    """Replace the text by the document type and one nullable column per field.

    All other columns stay. A table that already has a true type can name another ``type_column``.

    The three projections run in one stage. They are apart because what one of them computes is read several
    times by the next, and the optimizer does not merge such projections.
    """
    kept = [name for name in documents.columns if name not in (text, type_column)]
    source, lower = F.col(text), F.col("_folded")
    captured = documents.select(*kept, source, folded(source).alias("_folded")).select(
        *kept,
        document_type(source).alias(type_column),
        *[_capture(name, pattern, source, lower).alias(name) for name, pattern, _ in rules.FIELD_RULES],
        F.regexp_extract_all(source, F.lit(_MRZ_LINE), F.lit(1)).alias("_mrz"),
    )
    return captured.select(
        *kept,
        type_column,
        *[_value(name).alias(name) for name in rules.RULE_FIELDS],
        *[F.get("_mrz", F.lit(i)).alias(name) for i, name in enumerate(rules.MRZ_FIELDS)],
    )


def predictions(extracted: DataFrame, *keys: str) -> DataFrame:
    """One row per extracted field. The filter stands behind the explode, so no pattern runs twice."""
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"), F.col(name).alias("value"),
                F.lit(rules.CONFIDENCE[name]).alias("confidence"),
            )
            for name in rules.ALL_FIELDS
        ]
    )
    return (
        extracted.select(*(keys or ("doc_id",)), F.inline(entries))
        .filter(F.col("value").isNotNull())
        .withColumn("source", F.lit("regex"))
    )


def field_map(extracted: DataFrame, *keys: str) -> DataFrame:
    """Map from the name of every extracted field to its value and confidence."""
    entries = F.array(
        *[
            F.struct(
                F.lit(name),
                F.struct(F.col(name).alias("value"), F.lit(rules.CONFIDENCE[name]).alias("confidence")),
            )
            for name in rules.ALL_FIELDS
        ]
    )
    present = F.filter(entries, lambda e: e["col2"]["value"].isNotNull())
    return extracted.select(*(keys or ("doc_id",)), F.map_from_entries(present).alias("fields"))
