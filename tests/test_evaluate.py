import pytest
from pyspark.sql import functions as F

from docfields.operators import evaluate, extract, validate
from docfields.sources import corpora

TEXTS = [
    ("a", "x", "Total: 5 Tax: 1 id no Q-7", {"total_amount": " 5 ", "tax_amount": "2", "due_date": "2024-01-01"}),
    ("b", "x", "Account no 1234567", {"bank_account": "1,234,567", "vendor_name": "Acme", "tax_id": None, "x": ""}),
    ("c", "x", "nothing", {}),
]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(
        TEXTS, "doc_id string, doc_type_truth string, text string, truth map<string,string>"
    )


def test_statuses_and_both_forms(corpus):
    extracted = extract.extract(corpus)
    local = {(r.doc_id, r.name): r.status for r in evaluate.pair_documents(extracted).collect()}
    assert local == {
        ("a", "total_amount"): "tp", ("a", "tax_amount"): "wrong", ("a", "due_date"): "missed",
        ("a", "id_number"): "spurious", ("b", "bank_account"): "tp", ("b", "vendor_name"): "missed",
    }
    joined = evaluate.pair_tables(corpora.truth_table(corpus), extract.predictions(extracted))
    assert {(r.doc_id, r.name): r.status for r in joined.collect()} == local
    assert evaluate.sample_count(corpus).first().n_samples == 3


def test_records(corpus):
    rows = evaluate.sample_records(validate.check(extract.extract(corpus))).orderBy("doc_id").collect()
    assert [len(r.fields) for r in rows] == [4, 2, 0]
    assert rows[0].fields["tax_amount"].asDict() == {"gt": "2", "pred": "1", "status": "wrong"}
    assert (rows[0].doc_type_predicted, rows[0].doc_type_truth) == ("unknown", "x")


def test_metrics(spark):
    counts = spark.createDataFrame([("b", 2, 1, 0), ("a", 0, 3, 0)], "name string, tp long, fp long, fn long")
    report = [tuple(r) for r in evaluate.report(counts).collect()]
    assert report == [("a", 0, 3, 0, 0.0, 0.0, 0.0), ("b", 2, 1, 0, 0.667, 1.0, 0.8)]
    none = evaluate.micro_metrics(counts.filter("tp > 9")).first()
    assert tuple(none) == (0, 0, 0, 0.0, 0.0, 0.0)


def test_published_accuracy(spark):
    """Twenty clean invoices and ten cards whose second zone line has 29 characters."""
    orders = spark.createDataFrame(
        [(k,) for k in range(1, 21)], "o_orderkey long"
    ).withColumn("o_orderdate", F.expr("date_add(date '2024-01-01', cast(o_orderkey as int))"))
    lineitem = spark.createDataFrame(
        [(k, 1234.5 * k + i) for k in range(1, 21) for i in (0, 1)], "l_orderkey long, l_extendedprice double"
    )
    customer = spark.createDataFrame([(k, f"Customer#{k:09d}") for k in range(10)], "c_custkey long, c_name string")
    corpus = corpora.invoices(orders, lineitem, defects=False).unionByName(corpora.id_cards(customer, defects=False))
    extracted = extract.extract(corpus)
    counts = evaluate.count_outcomes(evaluate.pair_documents(extracted))
    micro = evaluate.rounded(evaluate.micro_metrics(counts)).first()
    assert (micro.precision, micro.recall, micro.f1) == (0.955, 1.0, 0.977)
    table = {r.field: (r.tp, r.fp, r.fn, r.f1) for r in evaluate.report(counts).collect()}
    assert table.pop("mrz_line1") == (0, 10, 0, 0.0)
    invoice = {"bank_account", "due_date", "invoice_date", "invoice_number", "routing_number", "subtotal_amount",
               "tax_amount", "tax_id", "total_amount"}
    assert table == {f: ((20 if f in invoice else 10), 0, 0, 1.0) for f in invoice | {"birth_date", "expiry_date", "id_number"}}
    assert validate.summarize(validate.check(extracted)).filter("not is_valid").count() == 0
    assert {r.doc_type for r in extracted.select("doc_type").distinct().collect()} == {"invoice", "id_card"}


def test_repeated_names_last_wins(spark):
    from docfields.operators import evaluate as ev

    schema = "doc_id string, name string, value string, seq int"
    truth = spark.createDataFrame([("d", "total", "10", 0), ("d", "total", "11", 1), ("d", "date", "x", 0), ("e", None, "z", 0)], schema)
    predicted = spark.createDataFrame([("d", "total", "11", 0), ("d", "total", "10", 5), ("d", "total", "12", 1)], schema)
    assert sorted(map(tuple, ev.pair_tables(truth, predicted, "seq").collect())) == [
        ("d", "date", "x", "", "missed"), ("d", "total", "11", "10", "wrong")]
    assert sorted(map(tuple, ev.pair_tables(truth, predicted).collect())) == [
        ("d", "date", "x", "", "missed"), ("d", "total", "11", "12", "wrong")]
