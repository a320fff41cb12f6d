import hashlib
from decimal import Decimal

from pyspark.sql import functions as F

from docfields import schemas
from docfields.operators import tokens


def _words(spark, rows):
    """Rows of (doc, page, pos, text, conf)."""
    data = [(d, f"page{p}", p, i, t, c, 10, 20, 5, 6) for d, p, i, t, c in rows]
    return spark.createDataFrame(data, schemas.WORDS)


def test_clean_words(spark):
    rows = _words(spark, [("a", 0, 0, " x ", 95.0), ("a", 0, 1, " ", 10.0), ("a", 0, 2, None, 10.0)])
    cleaned = tokens.clean_words(rows).collect()
    assert [(r.text, r.confidence, r.bbox) for r in cleaned] == [("x", 0.95, [10, 20, 15, 26])]


def test_pages_and_documents(spark):
    words = _words(
        spark,
        [("a", 0, 1, "two", 60.0), ("a", 0, 0, "one", 80.0), ("a", 1, 0, " ", 5.0), ("a", 2, 0, "three", 100.0),
         ("b", 0, 0, "", 1.0)],
    )
    pages = {(r.doc_id, r.page_index): r for r in tokens.assemble_pages(words).collect()}
    assert pages["a", 0].page_text == "one two" and pages["a", 0].avg_confidence == 0.7
    assert pages["a", 1].page_text == "" and pages["a", 1].token_count == 0 and pages["a", 1].avg_confidence == 0.0
    documents = {r.doc_id: r for r in tokens.assemble_documents(words).collect()}
    assert documents["a"].full_text == "one two\n\nthree"
    assert (documents["a"].pages, documents["a"].token_count, documents["a"].avg_confidence) == (3, 3, 0.8)
    assert (documents["b"].full_text, documents["b"].avg_confidence) == ("", 0.0)


def test_page_list_adds_wordless_pages(spark):
    words = _words(spark, [("a", 1, 0, "x", 50.0)])
    pages = spark.createDataFrame([("a", 0, "page0"), ("a", 1, "page1"), ("a", 2, "page2"), ("c", 0, "page0")],
                                  "doc_id string, page_index int, page_name string")
    texts = {r.doc_id: r.full_text for r in tokens.assemble_documents(words, pages).collect()}
    assert texts == {"a": "\nx\n", "c": ""}


def test_page_numbers_with_gaps_and_blocks(spark):
    indexes = [0, 5, 1023, 1024, 1030, 5000]
    words = _words(spark, [("a", p, i, "x", 1.0) for p in indexes for i in (0, 1)] + [("b", 7, 0, "x", 1.0)])
    numbered = {(r.doc_id, r.page_index): r.page_num for r in tokens.number_pages(words).collect()}
    assert numbered == {("a", p): n for n, p in enumerate(indexes, 1)} | {("b", 7): 1}


def test_page_cap(spark):
    words = _words(spark, [("a", p, 0, "x", 1.0) for p in range(4)])
    assert tokens.cap_pages(words, 2).count() == 2
    assert tokens.cap_pages(words, None).count() == 4


def test_one_huge_document_among_small_ones(spark):
    count = 3 * tokens.PART_WORDS + 17
    huge = spark.range(count).select(
        F.lit("huge").alias("doc_id"), F.lit("page0").alias("page_name"), F.lit(0).alias("page_index"),
        F.col("id").cast("int").alias("pos"), F.concat(F.lit("w"), "id").alias("text"), F.lit(50.0).alias("conf"),
        *[F.lit(1).alias(c) for c in ("left", "top", "width", "height")],
    )
    words = huge.unionByName(_words(spark, [("small", 0, 0, "x", 1.0)])).repartition(7)
    texts = {r.doc_id: r.full_text for r in tokens.assemble_documents(words).collect()}
    assert texts == {"huge": " ".join(f"w{i}" for i in range(count)), "small": "x"}
    record = tokens.ocr_results(words).filter("doc_id = 'huge'").first()
    assert [t.text for t in record.tokens] == [f"w{i}" for i in range(count)]
    assert record.full_text == " ".join(f"w{i}" for i in range(count))
    assert record.metadata.asDict() == {"avg_confidence": 0.5, "token_count": count}


def test_a_long_page_is_one_record(spark):
    words = _words(spark, [("a", 0, i, f"w{i}", float(i % 100)) for i in range(5000)])
    records = tokens.ocr_results(words.repartition(5)).collect()
    assert len(records) == 1 and len(records[0].tokens) == 5000
    assert records[0].metadata.asDict() == {"avg_confidence": 0.495, "token_count": 5000}


def test_pages_without_words_have_records(spark):
    words = _words(spark, [("a", 1, 0, "x", 50.0), ("a", 3, 0, " ", 70.0)])
    pages = spark.createDataFrame([("a", 0, "page0"), ("a", 1, "page1"), ("b", 0, "page0")],
                                  "doc_id string, page_index int, page_name string")
    found = {(r.doc_id, r.page_num): (len(r.tokens), r.full_text, r.metadata.avg_confidence) for r in tokens.ocr_results(words, pages).collect()}
    assert found == {("a", 1): (0, "", 0.0), ("a", 2): (1, "x", 0.5), ("a", 3): (0, "", 0.0), ("b", 1): (0, "", 0.0)}


def test_confidences_are_summed_exactly(spark):
    values = [0.1, 0.2, 0.1234567890123456, 99.99999999999999]
    words = _words(spark, [("a", 0, i, "x", v) for i, v in enumerate(values)])
    mean = float(sum(map(Decimal, map(repr, values)))) / 4 / 100
    assert tokens.page_statistics(words).first().avg_confidence == mean


def test_fingerprint_uses_name_order(spark):
    words = _words(spark, [("a", p, 0, f"t{p}", 1.0) for p in (1, 2, 10)])
    row = tokens.fingerprint(tokens.assemble_pages(words)).first()
    assert row.checksum == hashlib.sha256(b"t1t10t2").hexdigest() and row.page_count == 3


def test_ocr_results(spark):
    words = _words(spark, [("a", 3, 1, "y", 60.0), ("a", 3, 0, " x ", 80.0), ("a", 1, 0, "z", 10.0)])
    rows = {r.page_num: r for r in tokens.ocr_results(words).collect()}
    assert rows[2].full_text == "x y" and [t.text for t in rows[2].tokens] == ["x", "y"]
    assert rows[2].metadata.asDict() == {"avg_confidence": 0.7, "token_count": 2}
    assert {t.page_num for t in rows[2].tokens} == {2}


def test_words_move_as_plain_values(spark, tmp_path):
    _words(spark, [("a", 0, 0, "x", 1.0)]).write.parquet(str(tmp_path / "words"))
    words = spark.read.parquet(str(tmp_path / "words"))
    for table in (tokens.assemble_pages(words), tokens.assemble_documents(words), tokens.fingerprint_words(words), tokens.ocr_results(words)):
        plan = table._jdf.queryExecution().executedPlan().toString()
        before_the_first_exchange = plan[plan.rindex("Exchange hashpartitioning"):]
        gathered = [line for line in before_the_first_exchange.splitlines() if "partial_" in line]
        assert gathered and all("listagg" not in line and "bbox" not in line for line in gathered)
        assert any("partial_collect_list(coalesce(word" in line for line in gathered)


def test_pages_of_one_index_with_several_names_and_groups(spark):
    rows = [("a", 0, "p", 0, "x", 50.0), ("a", 0, "p", 4096, "late", 70.0), ("a", 0, "q", 1, "y", 80.0), ("a", 0, None, 2, "z", None),
            ("a", 40, "", 0, " ", 10.0), ("a", 40, "r", 9000, "far", 30.0), (None, 1, "n", 0, "w", 20.0)]
    words = spark.createDataFrame([(d, name, p, i, t, c, 1, 2, 3, 4) for d, p, name, i, t, c in rows], schemas.WORDS).repartition(5)
    found = {(r.doc_id, r.page_index, r.page_name): (r.page_text, r.token_count, r.avg_confidence) for r in tokens.assemble_pages(words).collect()}
    assert found == {
        ("a", 0, "p"): ("x late", 2, 0.6), ("a", 0, "q"): ("y", 1, 0.8), ("a", 0, None): ("z", 1, 0.0),
        ("a", 40, ""): ("", 0, 0.0), ("a", 40, "r"): ("far", 1, 0.3), (None, 1, "n"): ("w", 1, 0.2),
    }
    texts = tokens.assemble_pages(words, text_only=True)
    assert texts.columns == ["doc_id", "page_index", "page_text"]
    assert sorted(map(str, texts.collect())) == sorted(map(str, tokens.assemble_pages(words).select(*texts.columns).collect()))
    document = {r.doc_id: r for r in tokens.assemble_documents(words).collect()}["a"]
    assert (document.pages, document.token_count) == (5, 5) and sorted(document.full_text.split("\n")) == ["", "far", "x late", "y", "z"]


def test_missing_numbers_stay_missing(spark):
    rows = [("a", "p", 0, 0, "x", None, 1, 2, 3, 4), ("a", "p", 0, 1, "y", 50.0, None, 2, 3, 4), ("a", "p", 0, 2, "z", 0.0, 0, 0, 0, 0)]
    record = tokens.ocr_results(spark.createDataFrame(rows, schemas.WORDS)).first()
    assert [(t.text, t.confidence, t.bbox) for t in record.tokens] == [
        ("x", None, [1, 2, 4, 6]), ("y", 0.5, [None, 2, None, 6]), ("z", 0.0, [0, 0, 0, 0])
    ]
    assert record.metadata.asDict() == {"avg_confidence": 50 / 3 / 100, "token_count": 3}
