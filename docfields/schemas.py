"""Explicit schemas of every table the library reads or writes; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _I, _B, _L = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType(), T.LongType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


# One row per recognised word. ``page_index`` is 0-based in input order, ``pos`` counts the words of a page.
WORDS = _struct(
    ("doc_id", _S), ("page_name", _S), ("page_index", _I), ("pos", _I), ("text", _S), ("conf", _D),
    ("left", _I), ("top", _I), ("width", _I), ("height", _I),
)

DOCUMENTS = _struct(("doc_id", _S), ("text", _S))

MESSAGE = _struct(("field", _S), ("message", _S), ("level", _S))

FIELD = _struct(("value", _S), ("confidence", _D), ("valid", _B))

TOP_FAILURES = T.ArrayType(_struct(("field", _S), ("failures", _L)))

RESPONSE = _struct(
    ("request_id", _S),
    (
        "documents",
        T.ArrayType(
            _struct(
                ("doc_type", _S),
                ("fields", T.MapType(_S, FIELD)),
                (
                    "validation_summary",
                    _struct(("errors", T.ArrayType(MESSAGE)), ("warnings", T.ArrayType(MESSAGE))),
                ),
            )
        ),
    ),
    ("metrics", _struct(("processing_time_ms", _D), ("ocr_avg_confidence", _D))),
    ("analytics", _struct(("top_failures", TOP_FAILURES))),
)

# One row per extracted field. The table on disk is laid out by run and document type.
EXTRACTIONS = _struct(
    ("request_id", _S), ("doc_type", _S), ("field_name", _S), ("value", _S), ("confidence", _D),
    ("valid", _B), ("created_at", T.TimestampType()),
)

CATALOG = _struct(
    ("name", _S), ("type", _S), ("values", T.ArrayType(_S)), ("patterns", T.ArrayType(_S))
)

TOKEN = _struct(("text", _S), ("confidence", _D), ("bbox", T.ArrayType(_I)), ("page_num", _I))

OCR_RESULT = _struct(
    ("doc_id", _S), ("page_num", _I), ("tokens", T.ArrayType(TOKEN)), ("full_text", _S),
    ("metadata", _struct(("avg_confidence", _D), ("token_count", _L))),
)

JUDGED = _struct(("gt", _S), ("pred", _S), ("status", _S))

SAMPLE_RECORD = _struct(
    ("doc_id", _S), ("doc_type_predicted", _S), ("doc_type_truth", _S), ("fields", T.MapType(_S, JUDGED)),
    ("validation_errors", T.ArrayType(MESSAGE)), ("validation_warnings", T.ArrayType(MESSAGE)),
)

_SCORES = (("tp", _L), ("fp", _L), ("fn", _L), ("precision", _D), ("recall", _D), ("f1", _D))

FIELD_REPORT = _struct(("field", _S), *_SCORES)

MICRO_REPORT = _struct(("n_samples", _L), *_SCORES)
