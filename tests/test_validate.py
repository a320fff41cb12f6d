import pytest

from docfields.operators import validate
from docfields.operators.extract import extract


def _fields(spark, *rows):
    """Checked table of given field values, the other fields absent."""
    empty = extract(spark.createDataFrame([(i, "") for i in range(len(rows))], "doc_id int, text string"))
    names = [n for n in empty.columns if n not in ("doc_id", "doc_type")]
    schema = "doc_id int, doc_type string, " + ", ".join(f"{n} string" for n in names)
    data = [(i, "invoice", *[row.get(n) for n in names]) for i, row in enumerate(rows)]
    return validate.check(spark.createDataFrame(data, schema))


def _summary(spark, *rows, **kwargs):
    return validate.summarize(_fields(spark, *rows)).orderBy("doc_id").collect()


def _totals(subtotal, tax, total):
    return {"subtotal_amount": subtotal, "tax_amount": tax, "total_amount": total}


def test_totals(spark):
    rows = _summary(
        spark,
        _totals("100.00", "10.00", "110.00") | {"invoice_number": "INV-123"},
        _totals("100.00", "10.00", "111.00"),
        _totals("100", "10", "110.02"),
        _totals("100", "10", "110.03"),
        _totals("100", None, "500"),
        _totals("100", "abc", "500"),
        _totals("100", "10.", "111.005"),
    )
    assert [r.is_valid for r in rows] == [True, False, True, False, True, True, False]
    assert rows[1].errors[0].message == "subtotal (100.00) + tax (10.00) != total (111.00); diff=1.00"
    assert rows[3].errors[0].message == "subtotal (100) + tax (10) != total (110.03); diff=0.03"
    assert rows[6].errors[0].message == "subtotal (100) + tax (10) != total (111.005); diff=1.005"


def test_tolerance_is_a_parameter(spark):
    table = _fields(spark, _totals("100", "10", "111")).drop(*map(validate.flag_column, validate.CHECKED_FIELDS))
    assert validate.summarize(validate.check(table, tolerance="1")).first().is_valid


def test_date_rules(spark):
    rows = _summary(
        spark,
        {"invoice_date": "2024-02-01", "due_date": "2024-01-31"},
        {"invoice_date": "2024-02-01", "due_date": "01/02/2024"},
        {"invoice_date": "1/2/24", "due_date": "2000-01-01"},
        {"expiry_date": "1989-12-31", "birth_date": "1990-01-01"},
        {"expiry_date": "1990-01-01", "birth_date": "1990-01-01"},
    )
    assert [len(r.warnings) for r in rows] == [1, 0, 0, 0, 0]
    assert [r.is_valid for r in rows] == [True, True, True, False, True]
    assert rows[0].warnings[0].asDict() == {
        "field": "due_date", "message": "Due date earlier than invoice date", "level": "warning"
    }
    assert rows[3].errors[0].message == "Expiry date earlier than birth date"


@pytest.mark.parametrize(
    ("field", "value", "broken"),
    [
        ("invoice_number", "-5", True), ("invoice_number", "A-5", False), ("invoice_number", "", False),
        ("tax_id", "12345678", True), ("tax_id", "12-3456789", False), ("routing_number", "12345678", True),
        ("routing_number", "123456789\n", False), ("routing_number", "123456789\n\n", True),
        ("bank_account", "12345", True), ("id_number", "a b", True), ("id_number", "it's", True),
    ],
)
def test_format_rules(spark, field, value, broken):
    row = _summary(spark, {field: value})[0]
    assert bool(row.errors) == broken
    if broken:
        assert row.errors[0].message == f"Regex validation failed for value {value!r}"


def test_order_and_split(spark):
    bad = {"id_number": "a b", "invoice_number": "-1", "invoice_date": "2024-02-01", "due_date": "2024-01-01"}
    table = _fields(spark, bad | _totals("1", "1", "9"))
    found = [r.field for r in validate.messages(table).orderBy("rule").collect()]
    assert found == ["invoice_number", "id_number", "total_amount", "due_date"]
    flags = table.select(*[validate.field_is_valid(f).alias(f) for f in ("id_number", "due_date", "tax_id")]).first()
    assert tuple(flags) == (False, True, True)
