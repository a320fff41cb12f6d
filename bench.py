"""Benchmark: the headline queries over one table folder, one JSON line on standard output.

``BENCH_SF_DIR`` names the folder, ``BENCH_CPUS`` the number of local cores. Every query is computed in full
into Spark's no-op sink. The documents are rendered and written once, before the clock starts, because
rendering stands in for documents that a user already has; ``render`` reports what it takes.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from docfields.operators import analytics, evaluate, extract, records, tokens, validate
from docfields.session import local_session
from docfields.sources import corpora, writers
from docfields.streaming import jobs

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUN_ID = "bench"


def main() -> None:
    spark = local_session(CPUS, shuffle_partitions=int(CPUS) if CPUS.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    scratch = tempfile.mkdtemp(prefix="docfields-bench-")
    seconds: dict[str, float] = {}

    def timed(name: str, action: Callable[[], object]) -> None:
        start = time.perf_counter()
        action()
        seconds[name] = round(time.perf_counter() - start, 3)

    def render() -> None:
        # Like a table that many tasks have written: more files than cores.
        files = 4 * spark.sparkContext.defaultParallelism
        corpora.everything(spark, FOLDER).repartition(files).write.parquet(f"{scratch}/corpus")
        corpora.words_of(spark.read.parquet(f"{scratch}/corpus")).write.parquet(f"{scratch}/words")

    timed("render", render)
    corpus = spark.read.parquet(f"{scratch}/corpus")
    words = spark.read.parquet(f"{scratch}/words")
    documents = corpus.select("doc_id", "text")
    samples = extract.extract(corpus.withColumnRenamed("doc_type", "doc_type_truth"))
    checked = validate.check(extract.extract(documents))
    rows = records.field_rows(checked, RUN_ID)
    outcomes = evaluate.count_outcomes(evaluate.pair_documents(samples))
    assembled = tokens.assemble_documents(words)
    over_words = validate.check(extract.extract(assembled.select("doc_id", "full_text"), text="full_text"))
    queries: dict[str, DataFrame] = {
        "doc_type": analytics.documents_by_type(extract.extract(documents)),
        "predictions_long": extract.predictions(extract.extract(documents)),
        "field_valid": rows,
        "messages": validate.messages(checked),
        "top_failures": analytics.top_failures(rows),
        "errors_by_field": analytics.errors_by_field(checked),
        "response_nested": records.responses(checked, RUN_ID),
        "eval_report": evaluate.report(outcomes),
        "eval_micro": evaluate.micro_metrics(outcomes),
        "eval_pairs": evaluate.pair_tables(
            corpora.truth_table(corpus), extract.predictions(extract.extract(documents))
        ),
        "words_clean": tokens.clean_words(words),
        "page_stats": tokens.page_statistics(words),
        "page_renumber": tokens.number_pages(words),
        "document_text": assembled,
        "document_fingerprint": tokens.fingerprint_words(words),
        "ocr_results": tokens.ocr_results(words),
        "eval_records": evaluate.sample_records(validate.check(samples)),
        "extract_from_words": records.field_rows(over_words, RUN_ID),
        "corpus_invoices": corpora.invoices(
            spark.read.parquet(f"{FOLDER}/orders.parquet"), spark.read.parquet(f"{FOLDER}/lineitem.parquet")
        ),
    }
    for name, table in queries.items():
        timed(name, lambda table=table: table.write.format("noop").mode("overwrite").save())
    def streamed() -> None:
        stream = jobs.document_stream(spark, f"{scratch}/texts", 32)
        jobs.extract_and_store(stream, f"{scratch}/stream", f"{scratch}/stream-log", RUN_ID).awaitTermination()

    def counted_stream() -> None:
        stream = jobs.document_stream(spark, f"{scratch}/texts", 32)
        jobs.running_failures(stream, f"{scratch}/ranking", f"{scratch}/ranking-log", RUN_ID).awaitTermination()

    documents.write.parquet(f"{scratch}/texts")
    timed("write_responses", lambda: writers.write_responses(records.responses(checked, RUN_ID), f"{scratch}/responses"))
    timed("write_ocr_results", lambda: writers.write_ocr_results(tokens.ocr_results(words), f"{scratch}/ocr"))
    timed("write_evaluation", lambda: writers.write_evaluation(spark, evaluate.sample_records(validate.check(samples)), f"{scratch}/evaluation"))
    timed("append_extractions", lambda: writers.append_extractions(rows, f"{scratch}/table", RUN_ID))
    timed("stream_extract", streamed)
    timed("stream_failures", counted_stream)
    counted = corpus.count()
    micro = evaluate.rounded(evaluate.micro_metrics(outcomes)).first().asDict()
    total = sum(value for name, value in seconds.items() if name != "render")
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(total, 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
                "documents": counted,
                "documents_per_second": round(counted / seconds["field_valid"]),
                "micro": micro,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
