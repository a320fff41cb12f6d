"""Fixed values of the field rules: patterns, confidences, formats, limits.

Everything in this module has to equal the published rule set for results to agree, so it is stated as
plain text in its natural order. How the values are turned into Spark expressions is in
``docfields.functions`` and ``docfields.operators``.
"""

from __future__ import annotations

# --- Fixed values: field patterns (searched case-insensitively; group 1 is the value) and confidences ---
FIELD_RULES: tuple[tuple[str, str, float], ...] = (
    ("invoice_number", r"invoice\s*(?:no\.?|number|#)\s*[:\-]?\s*([A-Za-z0-9\-]+)", 0.85),
    (
        "invoice_date",
        r"(?:invoice\s*)?date\s*[:\-]?\s*([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4})",
        0.8,
    ),
    (
        "due_date",
        r"due\s*date\s*[:\-]?\s*([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4})",
        0.8,
    ),
    ("subtotal_amount", r"sub[\s\-]?total\s*[:\-]?\s*(?:[A-Z]{1,3}\s*)?\$?\s*([0-9][0-9,]*\.?[0-9]*)", 0.8),
    ("tax_amount", r"\btax\s*(?:amount)?\s*[:\-]?\s*(?:[A-Z]{1,3}\s*)?\$?\s*([0-9][0-9,]*\.?[0-9]*)", 0.75),
    (
        "total_amount",
        r"(?<!ub )\btotal\s*(?:due|amount)?\s*[:\-]?\s*(?:[A-Z]{1,3}\s*)?\$?\s*([0-9][0-9,]*\.?[0-9]*)",
        0.85,
    ),
    ("tax_id", r"tax\s*(?:id|number)\s*[:\-]?\s*([0-9A-Za-z\-]{9,15})", 0.7),
    ("routing_number", r"routing\s*(?:no\.?|number)\s*[:\-]?\s*([0-9]{9})\b", 0.8),
    ("bank_account", r"account\s*(?:number|no\.?)\s*[:\-]?\s*([0-9]{6,20})\b", 0.7),
    ("id_number", r"id\s*(?:no\.?|number)\s*[:\-]?\s*([A-Za-z0-9\-]+)", 0.7),
    (
        "expiry_date",
        r"(?:expiry|expires?)\s*[:\-]?\s*([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4})",
        0.7,
    ),
    (
        "birth_date",
        r"(?:date\s*of\s*birth|dob|birth\s*date)\s*[:\-]?\s*"
        r"([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4})",
        0.7,
    ),
)

# --- Fixed values: amount fields (thousands commas are dropped from their captures) ---
AMOUNT_FIELDS: tuple[str, ...] = ("subtotal_amount", "tax_amount", "total_amount")

# --- Fixed values: machine-readable-zone lines (case-sensitive; first and second match) ---
MRZ_PATTERN = r"([A-Z0-9<]{30}|[A-Z0-9<]{36}|[A-Z0-9<]{44})"
MRZ_FIELDS: tuple[str, ...] = ("mrz_line1", "mrz_line2")
MRZ_CONFIDENCE = 0.7

# --- Fixed values: document types and the substrings that decide them, first hit wins ---
INVOICE_WORDS: tuple[str, ...] = ("invoice",)
ID_CARD_WORDS: tuple[str, ...] = ("passport", "identification")  # or any machine-readable-zone line
TAX_FORM_WORDS: tuple[str, ...] = ("form", "irs", "1040")
UNKNOWN_TYPE = "unknown"

# --- Fixed values: format rules ---
FORMAT_RULES: tuple[tuple[str, str], ...] = (
    ("invoice_number", r"^[A-Za-z0-9][A-Za-z0-9\-]*$"),
    ("tax_id", r"^[0-9A-Za-z\-]{9,15}$"),
    ("routing_number", r"^[0-9]{9}$"),
    ("bank_account", r"^[0-9]{6,20}$"),
    ("id_number", r"^[0-9A-Za-z\-]+$"),
)

# --- Fixed values: message texts and levels ---
FORMAT_MESSAGE = "Regex validation failed for value "
DUE_DATE_MESSAGE = "Due date earlier than invoice date"
EXPIRY_MESSAGE = "Expiry date earlier than birth date"
ERROR = "error"
WARNING = "warning"

# --- Fixed values: limits ---
TOTAL_TOLERANCE = "0.02"
TOP_FAILURES_LIMIT = 20
RECURRENT_LIMIT = 10
ACCURACY_THRESHOLD = 0.9
LATENCY_BOUNDS_MS: tuple[int, ...] = (100, 250, 500, 1000, 2000, 3000, 5000, 10000)

# --- Fixed values: field catalog (name, type, allowed values, format patterns) ---
FIELD_CATALOG: tuple[tuple[str, str, tuple[str, ...], tuple[str, ...]], ...] = (
    ("document_type", "category", ("invoice", "tax_form", "id_card"), ()),
    ("invoice_number", "string", (), (r"^[A-Za-z0-9][A-Za-z0-9\-]*$",)),
    ("invoice_date", "date", (), ()),
    ("due_date", "date", (), ()),
    ("subtotal_amount", "amount", (), ()),
    ("tax_amount", "amount", (), ()),
    ("total_amount", "amount", (), ()),
    ("vendor_name", "string", (), ()),
    ("vendor_address", "string", (), ()),
    ("customer_name", "string", (), ()),
    ("customer_address", "string", (), ()),
    ("tax_id", "string", (), (r"^[0-9A-Za-z-]{9,15}$",)),
    ("bank_account", "string", (), (r"^[0-9]{6,20}$",)),
    ("routing_number", "string", (), (r"^[0-9]{9}$",)),
    ("id_number", "string", (), ()),
    ("expiry_date", "date", (), ()),
    ("birth_date", "date", (), ()),
    ("mrz_line1", "string", (), ()),
    ("mrz_line2", "string", (), ()),
)

RULE_FIELDS: tuple[str, ...] = tuple(name for name, _, _ in FIELD_RULES)
ALL_FIELDS: tuple[str, ...] = RULE_FIELDS + MRZ_FIELDS
CONFIDENCE: dict[str, float] = {
    **{name: confidence for name, _, confidence in FIELD_RULES},
    **{name: MRZ_CONFIDENCE for name in MRZ_FIELDS},
}
