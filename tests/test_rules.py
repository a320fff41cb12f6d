"""The fixed values by what they have to give: literal texts and expectations that no module repeats."""

import pytest

from docfields import rules

CAPTURES = [
    ("invoice_number", "Invoice No. : A-17b", "A-17b", 0.85), ("invoice_date", "Date 2024-02-03", "2024-02-03", 0.8),
    ("due_date", "DUE DATE: 1/2/24", "1/2/24", 0.8), ("subtotal_amount", "Sub-Total: USD $ 1,200.5", "1200.5", 0.8),
    ("tax_amount", "Tax Amount: EUR 3.", "3.", 0.75), ("total_amount", "TOTAL DUE - $99", "99", 0.85),
    ("tax_id", "Tax Number 12-3456789", "12-3456789", 0.7), ("routing_number", "Routing No: 123456789", "123456789", 0.8),
    ("bank_account", "account no. 123456", "123456", 0.7), ("id_number", "ID number: X-1", "X-1", 0.7),
    ("expiry_date", "Expires 31/12/2030", "31/12/2030", 0.7), ("birth_date", "Date of Birth: 1990-01-02", "1990-01-02", 0.7),
]
REJECTED = [
    ("invoice_number", "Invoice 17"), ("routing_number", "routing number 12345678"), ("bank_account", "account number 12345"),
    ("tax_id", "tax id 1234567"), ("expiry_date", "expiring 1/1/2030"), ("birth_date", "born 1990-01-02"),
]


def test_captures(read_text):
    rows = read_text(*[text for _, text, _, _ in CAPTURES])
    for row, (name, _, value, confidence) in zip(rows, CAPTURES, strict=True):
        assert row[name] == value and rules.CONFIDENCE[name] == confidence
    assert [name for name, *_ in CAPTURES] == list(rules.RULE_FIELDS)


def test_rejected(read_text):
    rows = read_text(*[text for _, text in REJECTED])
    assert all(row[name] is None for row, (name, _) in zip(rows, REJECTED, strict=True))


@pytest.mark.parametrize(
    ("text", "kind"),
    [("an Invoice, passport", "invoice"), ("PASSPORT form", "id_card"), ("identification", "id_card"), ("A" * 30, "id_card"), ("IRS", "tax_form"),
     ("form", "tax_form"), ("1040", "tax_form"), ("A" * 29, "unknown"), ("nothing", "unknown")],
)
def test_types(read_text, text, kind):
    assert read_text(text)[0].doc_type == kind


def test_limits_and_messages():
    assert (rules.TOTAL_TOLERANCE, rules.TOP_FAILURES_LIMIT, rules.RECURRENT_LIMIT, rules.ACCURACY_THRESHOLD) == ("0.02", 20, 10, 0.9)
    assert rules.LATENCY_BOUNDS_MS == (100, 250, 500, 1000, 2000, 3000, 5000, 10000)
    assert rules.MRZ_CONFIDENCE == 0.7 and (rules.ERROR, rules.WARNING) == ("error", "warning")
    assert rules.FORMAT_MESSAGE == "Regex validation failed for value "
    assert (rules.DUE_DATE_MESSAGE, rules.EXPIRY_MESSAGE) == (
        "Due date earlier than invoice date", "Expiry date earlier than birth date")
    assert [name for name, *_ in rules.FIELD_CATALOG] == [
        "document_type", "invoice_number", "invoice_date", "due_date", "subtotal_amount", "tax_amount", "total_amount", "vendor_name",
        "vendor_address", "customer_name", "customer_address", "tax_id", "bank_account", "routing_number", "id_number", "expiry_date",
        "birth_date", "mrz_line1", "mrz_line2"]
