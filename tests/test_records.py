import pytest
from pyspark.sql import functions as F

from docfields import rules, schemas
from docfields.operators import analytics, records
from docfields.operators.extract import extract
from docfields.operators.validate import check
from docfields.sources import admission, readers, writers


@pytest.fixture(scope="module")
def checked(spark):
    texts = [
        ("a", "Invoice Number: -5 Total: 3"),
        ("b", "Sub total: 1 Tax: 1 Total: 5 Account no 1234567"),
        ("c", "Invoice no: -7"),
        ("d", "nothing"),
    ]
    return check(extract(spark.createDataFrame(texts, "doc_id string, text string")))


def _rows(table):
    return sorted(map(tuple, table.collect()))


def test_field_rows_equal_flattened_responses(checked):
    nested = records.responses(checked, "r")
    assert nested.schema.simpleString() == schemas.RESPONSE.simpleString()
    direct = records.field_rows(checked, "r")
    assert _rows(direct) == _rows(records.flatten_responses(nested))
    assert direct.filter("not valid").count() == 3


def test_request_ids_are_stable_and_per_run(checked):
    def ids(run):
        return {r[0] for r in records.field_rows(checked, run).select("request_id").collect()}

    assert ids("r") == ids("r") and not ids("r") & ids("s") and len(ids("r")) == 3


def test_flatten_defaults(spark):
    line = (
        '{"request_id":"q","documents":[{"doc_type":"x","fields":{"a":{},"b":{"value":1.5,"valid":true}}},'
        '{"doc_type":"y","fields":{}}]}'
    )
    table = spark.createDataFrame([(line,)], "j string").select(F.from_json("j", schemas.RESPONSE).alias("r"))
    assert _rows(records.flatten_responses(table.select("r.*"))) == [
        ("q", "x", "a", "None", 0.0, False), ("q", "x", "b", "1.5", 0.0, True)
    ]


def test_json_round_trip_and_pretty_files(spark, checked, tmp_path):
    nested = records.responses(checked, "r", latency_ms=F.lit(12.5), confidence=F.lit(0.5))
    writers.write_responses(nested, str(tmp_path / "lines"))
    back = readers.read_responses(spark, str(tmp_path / "lines"))
    assert _rows(records.flatten_responses(back)) == _rows(records.field_rows(checked, "r"))
    assert back.select("metrics.processing_time_ms").first()[0] == 12.5
    (tmp_path / "pretty.json").write_text('{\n "request_id": "p",\n "documents": []\n}')
    assert readers.read_responses(spark, str(tmp_path / "pretty.json"), multi_line=True).first().request_id == "p"


def test_append_is_per_run_and_repeatable(spark, checked, tmp_path):
    path = str(tmp_path / "extractions")
    assert readers.read_extractions(spark, path).count() == 0
    writers.append_extractions(records.field_rows(checked.filter("doc_id = 'd'"), "none"), path, "none")
    assert readers.read_extractions(spark, path).count() == 0
    rows = records.field_rows(checked, "r")
    for run in ("r1", "r2", "r2"):
        writers.append_extractions(rows, path, run)
    stored = readers.read_extractions(spark, path)
    assert stored.count() == 2 * rows.count() and stored.columns == schemas.EXTRACTIONS.names
    assert stored.filter("created_at IS NULL").count() == 0


def test_rankings(spark):
    rows = [("b", "v", False), ("a", "v", False), ("c", "v", False), ("c", "v", False), ("c", "w", True), ("d", "v", None)]
    table = spark.createDataFrame(rows, "field_name string, value string, valid boolean")
    assert [tuple(r) for r in analytics.top_failures(table).collect()] == [("c", 2), ("a", 1), ("b", 1)]
    assert analytics.top_failures(table, 1).count() == 1
    assert analytics.recurrent_failures(table).columns == ["field_name", "failures"]
    assert [tuple(r) for r in analytics.low_accuracy_values(table, "c").collect()] == [("v", 2, 0.0)]
    assert analytics.low_accuracy_values(table).count() == 0
    names = {r.name: r.extracted for r in analytics.field_coverage(
        table.withColumns({"field_name": F.lit("tax_id"), "doc_type": F.lit("x"), "request_id": F.col("value")}), readers.field_catalog(spark)).collect()}
    assert len(names) == len(rules.FIELD_CATALOG) and names["tax_id"] == 6 and names["vendor_name"] == 0
    assert names["document_type"] == 2


def test_counters(checked):
    assert {r.field: r.errors for r in analytics.errors_by_field(checked).collect()} == {
        "invoice_number": 2, "total_amount": 1
    }
    assert {r.doc_type: r.documents for r in analytics.documents_by_type(checked).collect()} == {
        "invoice": 2, "unknown": 2
    }


def test_histogram(spark):
    table = spark.createDataFrame([(100,), (101,), (20000,), (None,)], "ms int")
    rows = {r.le: (r.bucket, r.observations, r.total) for r in analytics.histogram(table, "ms").collect()}
    assert rows["100"] == (1, 3, 20201) and rows["250"] == (2, 3, 20201) and rows["10000"] == (2, 3, 20201)
    assert rows["+Inf"] == (3, 3, 20201)
    empty = analytics.histogram(table.filter("ms < 0"), "ms").filter("le = '+Inf'").first()
    assert (empty.bucket, empty.total) == (0, 0)


def test_attach_top_failures(checked):
    nested = records.attach_top_failures(records.responses(checked, "r"), records.field_rows(checked, "r"))
    assert nested.count() == 4
    for row in nested.collect():
        assert [tuple(e) for e in row.analytics.top_failures] == [("invoice_number", 2), ("total_amount", 1)]
    plan = nested._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_admission(spark):
    names = ["a.pdf", "A.PDF", ".pdf", "a.pdf.txt", "pdf", "", None]
    files = spark.createDataFrame(list(enumerate(names)), "i int, name string")
    assert [r.i for r in admission.admitted(files, "name").orderBy("i").collect()] == [0, 1, 2]
    assert [r.i for r in admission.rejected(files, "name").orderBy("i").collect()] == [3, 4, 5, 6]


def test_word_sources(spark, tmp_path):
    header = "\t".join(schemas.WORDS.names)
    (tmp_path / "w.tsv").write_text(header + '\nd\tpage0\t0\t1\tsay "x\t95.5\t1\t2\t3\t4\n')
    row = readers.read_words(spark, str(tmp_path / "w.tsv"), "tsv").first()
    assert (row.text, row.conf, row.height) == ('say "x', 95.5, 4)
    table = readers.read_words(spark, str(tmp_path / "w.tsv"), "tsv")
    for form in ("parquet", "json"):
        table.write.format(form).save(str(tmp_path / form))
        assert readers.read_words(spark, str(tmp_path / form), form).first() == row


def test_document_source(spark, tmp_path):
    spark.createDataFrame([(7, "hello")], "key int, body string").write.parquet(str(tmp_path / "d"))
    table = readers.read_documents(spark, str(tmp_path / "d"), doc_id="key", text="body")
    assert [tuple(r) for r in table.collect()] == [("7", "hello")]


def test_malformed_responses_are_quarantined_and_counted(spark, tmp_path):
    lines = ['{"request_id": "a", "documents": []}', '{"request_id": "b", "docu', "", "[1, 2]", "not json", '{"request_id": "c"}']
    (tmp_path / "in.json").write_text("\n".join(lines) + "\n")
    good, counts = readers.read_responses_quarantined(spark, str(tmp_path / "in.json"), str(tmp_path / "bad"))
    assert sorted(r.request_id for r in good.collect()) == ["a", "c"]
    assert tuple(counts.first()) == (2, 3, 5)
    assert sorted(spark.read.text(str(tmp_path / "bad")).collect()) == sorted(
        spark.createDataFrame([(x,) for x in ('{"request_id": "b", "docu', "[1, 2]", "not json")], "value string").collect())
