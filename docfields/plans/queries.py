"""The registered queries: every operator applied to whole tables of one folder."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields import rules
from docfields.functions.amounts import difference_text, normalize_amount
from docfields.functions.dates import normalize_date
from docfields.operators import analytics, evaluate, extract, records, tokens, validate
from docfields.schemas import DOCUMENTS, FIELD_REPORT, MICRO_REPORT, OCR_RESULT, RESPONSE, SAMPLE_RECORD
from docfields.session import fresh_path
from docfields.sources import admission, corpora, published, readers, writers
from docfields.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]

RUN_ID = "run-1"
PRICE_BOUNDS = (1000, 10000, 50000, 100000, 200000, 300000, 400000, 500000)
# Files of the written corpus that one micro-batch takes.
STREAM_FILES = 4
# So many micro-batches take a backlog of more files than that; each then has files for all cores.
STREAM_BATCHES = 8


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _invoices(spark: SparkSession, folder: str) -> DataFrame:
    return corpora.invoices(_table(spark, folder, "orders"), _table(spark, folder, "lineitem"))


def _extracted(spark: SparkSession, folder: str) -> DataFrame:
    return extract.extract(corpora.everything(spark, folder).drop("truth"))


def _checked(spark: SparkSession, folder: str) -> DataFrame:
    return validate.check(_extracted(spark, folder))


def _field_rows(spark: SparkSession, folder: str) -> DataFrame:
    return records.field_rows(_checked(spark, folder), RUN_ID)


def _words(spark: SparkSession, folder: str) -> DataFrame:
    return corpora.words_of(corpora.everything(spark, folder))


def _samples(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with their truth, their true type and the extracted fields."""
    corpus = corpora.everything(spark, folder).withColumnRenamed("doc_type", "doc_type_truth")
    return extract.extract(corpus)


def _outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.count_outcomes(evaluate.pair_documents(_samples(spark, folder)))


def _message_text(field: str) -> Column:
    return validate.message(field)["message"].alias("message")


# --- corpora -----------------------------------------------------------------------------------------------


def corpus_invoices(spark: SparkSession, folder: str) -> DataFrame:
    return _invoices(spark, folder).select("doc_id", "doc_type", "text")


def corpus_id_cards(spark: SparkSession, folder: str) -> DataFrame:
    return corpora.id_cards(_table(spark, folder, "customer")).select("doc_id", "doc_type", "text")


def corpus_all(spark: SparkSession, folder: str) -> DataFrame:
    return corpora.everything(spark, folder).select("doc_id", "doc_type", "text")


def corpus_truth(spark: SparkSession, folder: str) -> DataFrame:
    return corpora.truth_table(corpora.everything(spark, folder))


# --- words, pages, documents -------------------------------------------------------------------------------


def words_clean(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.clean_words(_words(spark, folder)).select("doc_id", "page_index", "pos", "text", "confidence")


def words_boxes(spark: SparkSession, folder: str) -> DataFrame:
    corners = [F.col("bbox")[i].alias(name) for i, name in enumerate(("x0", "y0", "x1", "y1"))]
    return tokens.clean_words(_words(spark, folder)).select("doc_id", "pos", *corners)


def words_complete(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of all texts against the cleaned words: none may be lost."""
    texts = corpora.everything(spark, folder).select(F.explode(F.split("text", r"[ \t\r\n]+")).alias("token"))
    cleaned = tokens.clean_words(_words(spark, folder)).agg(
        F.count("*").alias("words"), F.sum(F.length("text")).alias("characters")
    )
    counted = texts.filter(F.col("token") != "").agg(F.count("*"))
    return cleaned.select(counted.scalar().alias("tokens"), "words", "characters")


def page_renumber(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.number_pages(_words(spark, folder))


def page_cap(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.cap_pages(_words(spark, folder), 2).select("doc_id", "page_index", "pos")


def page_text(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.assemble_pages(_words(spark, folder), text_only=True).select("doc_id", "page_index", "page_text")


def document_text(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.assemble_documents(_words(spark, folder)).select("doc_id", "full_text")


def page_stats(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.page_statistics(_words(spark, folder)).drop("page_name")


def document_stats(spark: SparkSession, folder: str) -> DataFrame:
    documents = tokens.assemble_documents(_words(spark, folder))
    return documents.select("doc_id", "pages", "token_count", "avg_confidence")


def document_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.fingerprint_words(_words(spark, folder))


def extract_from_words(spark: SparkSession, folder: str) -> DataFrame:
    """Words to pages to text to fields to stored rows: the whole path of a document."""
    documents = tokens.assemble_documents(_words(spark, folder)).select("doc_id", "full_text")
    return records.field_rows(validate.check(extract.extract(documents, text="full_text")), RUN_ID)


def response_from_words(spark: SparkSession, folder: str) -> DataFrame:
    """Words to nested responses with the mean confidence of their words, and the messages inside them, one row each."""
    assembled = tokens.assemble_documents(_words(spark, folder)).select("doc_id", "full_text", "avg_confidence")
    checked = validate.check(extract.extract(assembled, text="full_text"))
    nested = records.responses(checked, RUN_ID, confidence=F.col("avg_confidence"))
    summary = F.col("documents")[0]["validation_summary"]
    listed = F.concat(
        F.transform(summary["errors"], lambda m, i: F.struct(F.lit("errors").alias("list"), i.alias("place"), m.alias("m"))),
        F.transform(summary["warnings"], lambda m, i: F.struct(F.lit("warnings").alias("list"), i.alias("place"), m.alias("m"))),
    )
    return nested.select(
        "request_id", "metrics.ocr_avg_confidence", F.explode_outer(listed).alias("entry")
    ).select("request_id", "ocr_avg_confidence", "entry.list", "entry.place", "entry.m.field", "entry.m.message", "entry.m.level")


def words_stored(spark: SparkSession, folder: str) -> DataFrame:
    """Word tables in each stored form, read back."""
    words = _words(spark, folder)
    counted = []
    for form in ("parquet", "json"):
        path = fresh_path(spark, f"words-{form}")
        writers.write_words(words, path, form)
        counted.append(readers.read_words(spark, path, form).withColumn("form", F.lit(form)))
    return counted[0].unionByName(counted[1]).groupBy("form", "page_index").agg(
        F.count("*").alias("words"), F.sum("pos").alias("positions"), F.sum(F.length("text")).alias("characters"),
        F.sum("conf").alias("confidence"), F.sum("left").alias("left_sum"), F.max("height").alias("height"),
    )


def documents_stored(spark: SparkSession, folder: str) -> DataFrame:
    """Document texts under other column names, stored as JSON lines and as text with a header, read back."""
    texts = corpora.everything(spark, folder).select(F.col("doc_id").alias("key"), F.col("text").alias("body"))
    lines, table = fresh_path(spark, "texts-json"), fresh_path(spark, "texts-csv")
    texts.write.json(lines)
    texts.write.option("header", True).option("multiLine", True).option("escape", '"').csv(table)
    schema = "key STRING, body STRING"
    found = readers.read_documents(spark, lines, "json", "key", "body", schema=schema)
    other = readers.read_documents(
        spark, table, "csv", "key", "body", schema=schema, options={"header": True, "multiLine": True, "escape": '"'}
    )
    return found.join(other.withColumnRenamed("text", "other"), "doc_id").select(
        "doc_id", F.sha2("text", 256).alias("digest"), F.col("text").eqNullSafe(F.col("other")).alias("same")
    )


# --- extraction --------------------------------------------------------------------------------------------


def _extract_field(field: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return _extracted(spark, folder).select("doc_id", field)

    return query


def amounts_clean(spark: SparkSession, folder: str) -> DataFrame:
    return _extracted(spark, folder).select("doc_id", *rules.AMOUNT_FIELDS)


def extract_mrz(spark: SparkSession, folder: str) -> DataFrame:
    return _extracted(spark, folder).select("doc_id", *rules.MRZ_FIELDS)


def doc_type(spark: SparkSession, folder: str) -> DataFrame:
    return _extracted(spark, folder).select("doc_id", "doc_type")


def predictions_long(spark: SparkSession, folder: str) -> DataFrame:
    return extract.predictions(_extracted(spark, folder))


def field_map(spark: SparkSession, folder: str) -> DataFrame:
    maps = extract.field_map(_extracted(spark, folder))
    entries = maps.select("doc_id", F.explode_outer("fields").alias("name", "field"))
    return entries.filter(F.col("name").isNotNull()).select("doc_id", "name", "field.*")


def normalize_amounts(spark: SparkSession, folder: str) -> DataFrame:
    table = _extracted(spark, folder)
    return table.select(
        "doc_id", *[normalize_amount(F.col(f)).cast("double").alias(f) for f in rules.AMOUNT_FIELDS]
    )


def normalize_dates(spark: SparkSession, folder: str) -> DataFrame:
    fields = ("invoice_date", "due_date", "expiry_date", "birth_date")
    table = _extracted(spark, folder)
    return table.select("doc_id", *[normalize_date(F.col(f)).cast("string").alias(f) for f in fields])


# --- validation --------------------------------------------------------------------------------------------


def _check_format(field: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return _checked(spark, folder).select("doc_id", F.col(field).alias("value"), _message_text(field))

    return query


def check_totals(spark: SparkSession, folder: str) -> DataFrame:
    difference = validate.total_difference(*[F.col(f) for f in rules.AMOUNT_FIELDS])
    return _checked(spark, folder).select(
        "doc_id", difference_text(difference, F.lit(40)).cast("double").alias("difference"), _message_text("total_amount")
    )


def huge_amounts(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of amounts that no decimal type holds: every order's sum behind as many more digits as its key gives."""
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string")
    head = F.repeat(F.lit("9"), (F.col("o_orderkey") % 40).cast("int"))
    texts = _table(spark, folder, "orders").select(
        F.concat(F.lit("huge-"), "o_orderkey").alias("doc_id"),
        F.concat(
            F.lit("Subtotal: 0"), F.when(F.col("o_orderkey") % 3 == 0, "1").otherwise("0"), F.lit(" Tax: 0 Total: "), head, cents
        ).alias("text"),
        F.concat(head, cents).alias("digits"),
    )
    return validate.check(extract.extract(texts)).select("doc_id", "digits", F.col("bad_total_amount").alias("differs"))


def check_due_date(spark: SparkSession, folder: str) -> DataFrame:
    return _checked(spark, folder).select("doc_id", _message_text("due_date"))


def check_expiry(spark: SparkSession, folder: str) -> DataFrame:
    return _checked(spark, folder).select("doc_id", _message_text("expiry_date"))


def messages(spark: SparkSession, folder: str) -> DataFrame:
    return validate.messages(_checked(spark, folder)).select("doc_id", "field", "message", "level")


def error_warning_split(spark: SparkSession, folder: str) -> DataFrame:
    summary = validate.summarize(_checked(spark, folder))
    errors, warnings = validate.split_by_level(F.concat("errors", "warnings"))

    def fields(found: Column) -> Column:
        return F.array_join(F.transform(found, lambda m: m["field"]), ",")

    return summary.select(
        "doc_id",
        F.size(errors).alias("n_errors"), fields(errors).alias("error_fields"),
        F.size(warnings).alias("n_warnings"), fields(warnings).alias("warning_fields"),
    )


def is_valid(spark: SparkSession, folder: str) -> DataFrame:
    return _checked(spark, folder).select("doc_id", validate.document_is_valid().alias("is_valid"))


def field_valid(spark: SparkSession, folder: str) -> DataFrame:
    return _field_rows(spark, folder).select("request_id", "field_name", "valid")


# --- records -----------------------------------------------------------------------------------------------


def response_nested(spark: SparkSession, folder: str) -> DataFrame:
    document = F.col("documents")[0]
    summary = document["validation_summary"]
    return records.responses(_checked(spark, folder), RUN_ID).select(
        "request_id",
        document["doc_type"].alias("doc_type"),
        F.size(document["fields"]).alias("n_fields"),
        F.size(summary["errors"]).alias("n_errors"),
        F.size(summary["warnings"]).alias("n_warnings"),
    )


def response_flat(spark: SparkSession, folder: str) -> DataFrame:
    return records.flatten_responses(records.responses(_checked(spark, folder), RUN_ID))


def response_json_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "responses")
    writers.write_responses(records.responses(_checked(spark, folder), RUN_ID), path)
    return records.flatten_responses(readers.read_responses(spark, path))


def persisted_extractions(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "extractions")
    writers.append_extractions(_field_rows(spark, folder), path, RUN_ID)
    return readers.read_extractions(spark, path).drop("created_at")


def responses_quarantined(spark: SparkSession, folder: str) -> DataFrame:
    """Responses as JSON lines, and beside them a truncated copy of every response whose request id starts with 0."""
    path = fresh_path(spark, "responses-mixed")
    responses = records.responses(_checked(spark, folder), RUN_ID)
    writers.write_responses(responses, f"{path}/good")
    line = F.to_json(F.struct(*responses.columns))
    broken = responses.filter(F.col("request_id").startswith("0")).select(F.substring(line, 1, 40).alias("value"))
    broken.write.text(f"{path}/broken")
    good, counts = readers.read_responses_quarantined(spark, f"{path}/*", fresh_path(spark, "quarantine"))
    return counts.select("*", F.lit(good.count()).alias("good_rows"))


def ocr_json_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """All pages with their texts and statistics, one row per token; a page without words has one row without."""
    path = fresh_path(spark, "ocr")
    writers.write_ocr_results(tokens.ocr_results(_words(spark, folder)), path)
    pages = spark.read.schema(OCR_RESULT).json(path)
    return pages.select(
        "doc_id", "page_num", "full_text", "metadata.token_count", "metadata.avg_confidence",
        F.posexplode_outer("tokens").alias("n", "t"),
    ).select(
        "doc_id", "page_num", "full_text", "token_count", "avg_confidence", "n", "t.text", "t.confidence",
        *[F.col("t.bbox")[i].alias(name) for i, name in enumerate(("x0", "y0", "x1", "y1"))],
    )


def _file_names(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    suffix = F.element_at(
        F.array(*[F.lit(s) for s in (".pdf", ".PDF", ".Pdf", ".png", ".pdf.txt")]), (k % 5 + 1).cast("int")
    )
    name = F.when(k % 35 == 0, None).when(k % 21 == 0, "").otherwise(F.concat(F.lit("order-"), k, suffix))
    return _table(spark, folder, "orders").select(k.alias("upload"), name.alias("name"))


def admitted(spark: SparkSession, folder: str) -> DataFrame:
    return admission.admitted(_file_names(spark, folder), "name")


def rejected(spark: SparkSession, folder: str) -> DataFrame:
    return admission.rejected(_file_names(spark, folder), "name")


# --- rankings and counters ---------------------------------------------------------------------------------


def field_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.field_coverage(_field_rows(spark, folder), readers.field_catalog(spark))


def top_failures(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.top_failures(_field_rows(spark, folder))


def recurrent_failures(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.recurrent_failures(_field_rows(spark, folder))


def low_accuracy_values(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.low_accuracy_values(_field_rows(spark, folder), "expiry_date")


def responses_with_failures(spark: SparkSession, folder: str) -> DataFrame:
    """The responses are stored first, so that rows, ranking and result come from one pass over the texts."""
    path, table = fresh_path(spark, "responses"), fresh_path(spark, "extractions")
    records.responses(_checked(spark, folder), RUN_ID).write.parquet(path)
    stored = spark.read.schema(RESPONSE).parquet(path)
    writers.append_extractions(records.flatten_responses(stored), table, RUN_ID)
    nested = records.attach_ranking(stored, published.top_failures(spark, table))
    ranking = F.transform("analytics.top_failures", lambda e: F.concat_ws(":", e["field"], e["failures"]))
    return nested.select("request_id", F.array_join(ranking, ";").alias("ranking"))


def docs_by_type(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.documents_by_type(_extracted(spark, folder))


def errors_by_field(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.errors_by_field(_checked(spark, folder))


def histogram_event_value(spark: SparkSession, folder: str) -> DataFrame:
    """Buckets of the values as they are; only the sum is made exact."""
    exact = F.col("value").cast("decimal(18,2)")
    found = analytics.histogram(_table(spark, folder, "events"), "value", summed=exact)
    return found.withColumn("total", F.col("total").cast("double"))


def histogram_order_price(spark: SparkSession, folder: str) -> DataFrame:
    exact = F.col("o_totalprice").cast("decimal(18,2)")
    found = analytics.histogram(_table(spark, folder, "orders"), "o_totalprice", PRICE_BOUNDS, summed=exact)
    return found.withColumn("total", F.col("total").cast("double"))


# --- evaluation --------------------------------------------------------------------------------------------


def eval_normalized(spark: SparkSession, folder: str) -> DataFrame:
    table = extract.predictions(_extracted(spark, folder))
    return table.select("doc_id", "name", evaluate.comparable(F.col("value")).alias("compared"))


def eval_pairs(spark: SparkSession, folder: str) -> DataFrame:
    truth = corpora.truth_table(corpora.everything(spark, folder))
    return evaluate.pair_tables(truth, extract.predictions(_extracted(spark, folder)))


def eval_pairs_repeated(spark: SparkSession, folder: str) -> DataFrame:
    """Both sides name fields more than once: an earlier stale value everywhere, a later planted invoice number."""
    def variant(value: Column, seq: int) -> Column:
        return F.array(F.struct(value.alias("value"), F.lit(seq).alias("seq")))

    def repeated(table: DataFrame, *variants: Column) -> DataFrame:
        # All variants of a row come from one pass; unions would render and extract once for each.
        return table.select("doc_id", "name", F.explode_outer(F.concat(*variants)).alias("variant")).select("doc_id", "name", "variant.*")

    value = F.col("value")
    truth = corpora.truth_table(corpora.everything(spark, folder))
    truth = repeated(truth, variant(value, 0), variant(F.concat(value, F.lit("-stale")), -1))
    planted = variant(F.lit("planted"), 1)
    predicted = repeated(
        extract.predictions(_extracted(spark, folder)), variant(value, 0), variant(F.concat(value, F.lit("-old")), -1),
        F.when(F.col("name") == "invoice_number", planted).otherwise(F.filter(planted, lambda v: F.lit(False))),
    )
    return evaluate.pair_tables(truth, predicted, "seq")


def eval_pairs_local(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.pair_documents(_samples(spark, folder))


def eval_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _outcomes(spark, folder)


def eval_field_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.field_metrics(_outcomes(spark, folder))


def eval_micro(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.micro_metrics(_outcomes(spark, folder))


def eval_sample_count(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.sample_count(corpora.everything(spark, folder))


def _record_rows(stored: DataFrame) -> DataFrame:
    return stored.select(
        "doc_id", "doc_type_predicted", "doc_type_truth",
        F.size("validation_errors").alias("n_errors"), F.size("validation_warnings").alias("n_warnings"),
        F.explode_outer("fields").alias("name", "field"),
    ).select("*", "field.*").drop("field")


def eval_records(spark: SparkSession, folder: str) -> DataFrame:
    return _record_rows(evaluate.sample_records(validate.check(_samples(spark, folder))))


def eval_report(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.report(_outcomes(spark, folder))


def _written_evaluation(spark: SparkSession, folder: str) -> str:
    path = fresh_path(spark, "evaluation")
    writers.write_evaluation(spark, evaluate.sample_records(validate.check(_samples(spark, folder))), path)
    return path


def eval_written(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(FIELD_REPORT).json(f"{_written_evaluation(spark, folder)}/per_field")


def eval_written_micro(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MICRO_REPORT).json(f"{_written_evaluation(spark, folder)}/micro")


def eval_written_samples(spark: SparkSession, folder: str) -> DataFrame:
    stored = spark.read.schema(SAMPLE_RECORD).json(f"{_written_evaluation(spark, folder)}/samples")
    return _record_rows(stored)


# --- streaming ---------------------------------------------------------------------------------------------


def _files_per_batch(spark: SparkSession, source: str) -> int:
    """A backlog of very many files is taken in about ``STREAM_BATCHES`` micro-batches, however long it is."""
    return max(STREAM_FILES, math.ceil(len(spark.read.parquet(source).inputFiles()) / STREAM_BATCHES))


def _stored_documents(spark: SparkSession, folder: str) -> str:
    source = fresh_path(spark, "arrivals")
    corpora.everything(spark, folder).select("doc_id", "text").write.parquet(source)
    return source


def _arriving(spark: SparkSession, source: str) -> DataFrame:
    return jobs.document_stream(spark, source, _files_per_batch(spark, source))


def _arriving_documents(spark: SparkSession, folder: str) -> DataFrame:
    return _arriving(spark, _stored_documents(spark, folder))


def stream_extract(spark: SparkSession, folder: str) -> DataFrame:
    sink = fresh_path(spark, "stream-rows")
    checkpoint = fresh_path(spark, "stream-rows-log")
    jobs.extract_and_store(_arriving_documents(spark, folder), sink, checkpoint, RUN_ID).awaitTermination()
    return readers.read_extractions(spark, sink).drop("created_at")


REDELIVERY = "7 days"


def stream_redelivered(spark: SparkSession, folder: str) -> DataFrame:
    """Every document arrives twice, in two files of different micro-batches; each is stored once."""
    source = fresh_path(spark, "arrivals-twice")
    corpora.everything(spark, folder).select("doc_id", "text").write.parquet(source)
    # The second delivery is that of the files of the first.
    spark.read.schema(DOCUMENTS).parquet(source).write.mode("append").parquet(source)
    sink, checkpoint = fresh_path(spark, "redelivered"), fresh_path(spark, "redelivered-log")
    stream = jobs.document_stream(spark, source, _files_per_batch(spark, source))
    jobs.extract_and_store(stream, sink, checkpoint, RUN_ID, redelivery=REDELIVERY).awaitTermination()
    return readers.read_extractions(spark, sink).drop("created_at")


def stream_histogram_event_value(spark: SparkSession, folder: str) -> DataFrame:
    """The events arrive in many files, a few per micro-batch; the running buckets equal those of the whole table."""
    events = _table(spark, folder, "events")
    source = fresh_path(spark, "event-arrivals")
    events.repartition(4 * STREAM_FILES).write.parquet(source)
    sink, checkpoint = fresh_path(spark, "event-buckets"), fresh_path(spark, "event-buckets-log")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", STREAM_FILES).parquet(source)
    exact = F.col("value").cast("decimal(18,2)")
    jobs.running_histogram(stream, "value", sink, checkpoint, summed=exact).awaitTermination()
    found = jobs.latest_state(spark, sink, "le string, bucket long, observations long, total decimal(28,2)")
    return found.withColumn("total", F.col("total").cast("double"))


def stream_failures(spark: SparkSession, folder: str) -> DataFrame:
    sink = fresh_path(spark, "stream-ranking")
    checkpoint = fresh_path(spark, "stream-ranking-log")
    jobs.running_failures(_arriving_documents(spark, folder), sink, checkpoint, RUN_ID).awaitTermination()
    return jobs.latest_ranking(spark, sink)


def stream_docs_by_type(spark: SparkSession, folder: str) -> DataFrame:
    sink, checkpoint = fresh_path(spark, "stream-types"), fresh_path(spark, "stream-types-log")
    jobs.running_documents_by_type(_arriving_documents(spark, folder), sink, checkpoint).awaitTermination()
    return jobs.latest_state(spark, sink, "doc_type STRING, documents BIGINT")


def stream_errors_by_field(spark: SparkSession, folder: str) -> DataFrame:
    sink, checkpoint = fresh_path(spark, "stream-errors"), fresh_path(spark, "stream-errors-log")
    jobs.running_errors_by_field(_arriving_documents(spark, folder), sink, checkpoint).awaitTermination()
    return jobs.latest_state(spark, sink, "field STRING, errors BIGINT")


def stream_and_batch(spark: SparkSession, folder: str) -> DataFrame:
    """A batch run, a stream and a second batch run into one stored table: all of their rows."""
    path, checkpoint = fresh_path(spark, "shared-rows"), fresh_path(spark, "shared-rows-log")
    # Documents are rendered once, for the batch runs and the stream; both batch runs store what one check has found.
    source, found = _stored_documents(spark, folder), fresh_path(spark, "checked")
    validate.check(extract.extract(spark.read.schema(DOCUMENTS).parquet(source))).write.parquet(found)
    checked = spark.read.parquet(found)
    writers.append_extractions(records.field_rows(checked, "before"), path, "before")
    jobs.extract_and_store(_arriving(spark, source), path, checkpoint, RUN_ID).awaitTermination()
    writers.append_extractions(records.field_rows(checked, "after"), path, "after")
    return analytics.stored_by_validity(readers.read_extractions(spark, path))


# --- published tables ----------------------------------------------------------------------------------------


def published_rerun(spark: SparkSession, folder: str) -> DataFrame:
    """A run is published, then a rerun of it breaks on the executors: readers still see the first run, whole."""
    path, rows = fresh_path(spark, "published"), _field_rows(spark, folder)
    writers.append_extractions(rows, path, RUN_ID)
    broken = rows.withColumn("value", F.when(F.col("valid"), F.raise_error(F.lit("broken rerun"))).otherwise(F.col("value")))
    try:
        published.publish(broken, path, RUN_ID)
    except Exception as error:  # the failure is the point: it must not reach the readers
        if "broken rerun" not in str(error):
            raise
    return readers.read_extractions(spark, path).drop("created_at")


def published_compacted(spark: SparkSession, folder: str) -> DataFrame:
    """A stream publishes one attempt per epoch; they are compacted into one and the replaced ones removed."""
    sink, checkpoint = fresh_path(spark, "compacted"), fresh_path(spark, "compacted-log")
    jobs.extract_and_store(_arriving_documents(spark, folder), sink, checkpoint, RUN_ID).awaitTermination()
    published.compact(spark, sink, RUN_ID)
    published.vacuum(spark, sink, keep=1)
    return readers.read_extractions(spark, sink).drop("created_at")


def maintained_top_failures(spark: SparkSession, folder: str) -> DataFrame:
    """A batch run, a stream and another batch run into one table; the ranking is merged from their counters alone."""
    path, checkpoint = fresh_path(spark, "maintained"), fresh_path(spark, "maintained-log")
    checked = _checked(spark, folder)
    writers.append_extractions(records.field_rows(checked, "before"), path, "before")
    jobs.extract_and_store(_arriving_documents(spark, folder), path, checkpoint, RUN_ID).awaitTermination()
    writers.append_extractions(records.field_rows(checked, "after"), path, "after")
    return published.top_failures(spark, path)


def stream_failures_history(spark: SparkSession, folder: str) -> DataFrame:
    """The stream's own ranking after a batch run stored before it: it counts the batch run's rows too."""
    path, ranking = fresh_path(spark, "history"), fresh_path(spark, "history-ranking")
    writers.append_extractions(records.field_rows(_checked(spark, folder), "before"), path, "before")
    jobs.running_failures_over_history(
        _arriving_documents(spark, folder), path, ranking, fresh_path(spark, "history-log"), RUN_ID
    ).awaitTermination()
    return jobs.latest_ranking(spark, ranking)


def all_queries() -> dict[str, Query]:
    plain = (
        corpus_invoices, corpus_id_cards, corpus_all, corpus_truth,
        words_clean, words_boxes, words_complete, page_renumber, page_cap, page_text, document_text, page_stats,
        document_stats, document_fingerprint, extract_from_words, response_from_words, words_stored, documents_stored,
        amounts_clean, extract_mrz, doc_type, predictions_long, field_map,
        normalize_amounts, normalize_dates,
        check_totals, huge_amounts, check_due_date, check_expiry, messages, error_warning_split, is_valid, field_valid,
        response_nested, response_flat, response_json_roundtrip, responses_quarantined, persisted_extractions, ocr_json_roundtrip,
        admitted, rejected,
        field_coverage, top_failures, recurrent_failures, low_accuracy_values, responses_with_failures,
        docs_by_type, errors_by_field, histogram_event_value, histogram_order_price,
        eval_normalized, eval_pairs, eval_pairs_repeated, eval_pairs_local, eval_counts, eval_field_metrics, eval_micro,
        eval_sample_count, eval_records, eval_report, eval_written, eval_written_micro, eval_written_samples,
        stream_extract, stream_failures, stream_docs_by_type, stream_errors_by_field, stream_and_batch,
        stream_redelivered, stream_histogram_event_value, published_rerun, published_compacted, maintained_top_failures, stream_failures_history,
    )
    found: dict[str, Query] = {query.__name__: query for query in plain}
    found.update({f"extract_{field}": _extract_field(field) for field in rules.RULE_FIELDS})
    found.update({f"check_format_{field}": _check_format(field) for field, _ in rules.FORMAT_RULES})
    return found
