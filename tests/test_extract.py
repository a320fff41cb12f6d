import pytest

from docfields import rules
from docfields.operators import extract as ex


@pytest.mark.parametrize(
    ("text", "field", "value"),
    [
        ("sub total: 5 total: 6", "total_amount", "6"),
        ("sub-total 5", "total_amount", "5"),
        ("TAX ID 12-3456789", "tax_amount", "12"),
        ("Tax ID: 12-3456789", "tax_amount", None),
        ("did not see", "id_number", "t"),
        ("İD no 5", "id_number", "5"),
        ("Total of 5", "total_amount", "5"),
        ("Total due: 7", "total_amount", "7"),
        ("Total: USD $ 1,234.50", "total_amount", "1234.50"),
        ("invoice notice", "invoice_number", "tice"),
        ("Invoice Number: \nInvoice Date: 2024-01-01", "invoice_number", "Invoice"),
        ("Due Date: 2024-05-06", "invoice_date", "2024-05-06"),
        ("Expiry Date: 2024-05-06", "expiry_date", None),
        ("Expires 1/2/24", "expiry_date", "1/2/24"),
        ("DOB 01/02/1990", "birth_date", "01/02/1990"),
        ("Tax number 1234567890123456789", "tax_id", "123456789012345"),
        ("Routing No. 1234567890", "routing_number", None),
        ("Account no. 12345678", "bank_account", "12345678"),
        ("nothing", "total_amount", None),
        (None, "total_amount", None),
    ],
)
def test_literal_fields(read_text, text, field, value):
    assert read_text(text, "x")[0][field] == value


def test_mrz_lines(read_text):
    runs = [29, 30, 44, 60, 75]
    rows = read_text(*["A" * n for n in runs], "a" * 60)
    found = [sum(row[f] is not None for f in rules.MRZ_FIELDS) for row in rows]
    assert found == [0, 1, 1, 2, 2, 0]
    assert len(rows[2].mrz_line1) == 30


def test_document_types(read_text):
    texts = ["An INVOICE with passport", "Passport", "identification", "P<" + "A" * 28, "information", "first",
             "1040", "nothing here", ""]
    kinds = ["invoice", "id_card", "id_card", "id_card", "tax_form", "tax_form", "tax_form", "unknown", "unknown"]
    assert [row.doc_type for row in read_text(*texts)] == kinds


def test_predictions_and_map(spark):
    table = spark.createDataFrame([("d", "Total: 5 id no X", 7)], "doc_id string, text string, extra int")
    extracted = ex.extract(table)
    assert "extra" in extracted.columns and "text" not in extracted.columns
    rows = [tuple(r) for r in ex.predictions(extracted).collect()]
    assert rows == [("d", "total_amount", "5", 0.85, "regex"), ("d", "id_number", "X", 0.7, "regex")]
    fields = ex.field_map(extracted).first().fields
    assert {n: (f.value, f.confidence) for n, f in fields.items()} == {r[1]: r[2:4] for r in rows}
