"""The registered queries of this subpackage: each operator on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.llm import (
    language, line_dedup, manifest, merkle, mixing, near_dup, packing, prefix_trie, quality, quality_model, secrets, toxicity,
    warc,
)
from docfields.llm.common import fold, table

TOXIC_FOLDS = 5
LANGUAGE_FOLDS = 3
LANGUAGE_HELD_OUT = 1
QUALITY_FOLDS = 5


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, folder, "documents"))


def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.find_secrets(table(spark, folder, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"
    )


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.assess(table(spark, folder, "documents"))


def op5_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.neighbours(table(spark, folder, "documents"))


def op6_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_warc_archives(spark: SparkSession, folder: str) -> DataFrame:
    read = warc.round_trip(table(spark, folder, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "block_bytes", "error")


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = line_dedup.drop_boilerplate(table(spark, folder, "documents"), F.col("source"))
    return cleaned.select("doc_id", "cleaned.text", "cleaned.n_lines", "cleaned.n_dropped")


def toxicity_model(documents: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Learned from the labels of all folds but the held-out one."""
    return toxicity.learn(documents, labels, fold(F.col("doc_id"), TOXIC_FOLDS) != 0)


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    scored = toxicity.toxicity(documents, toxicity_model(documents, table(spark, folder, "labels")))
    held_out = F.coalesce(fold(F.col("doc_id"), TOXIC_FOLDS) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    fold_of = fold(F.col("doc_id"), LANGUAGE_FOLDS)
    model = language.learn(documents, fold_of != LANGUAGE_HELD_OUT)
    held_out = F.coalesce(fold_of == LANGUAGE_HELD_OUT, F.lit(False))
    return language.identify(documents, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    tree = manifest.manifest(table(spark, folder, "documents"))
    return tree.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "lang")


def op12_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    trie = prefix_trie.prefix_trie(table(spark, folder, "conversations"))
    return trie.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    fold_of = fold(F.col("doc_id"), QUALITY_FOLDS)
    model = quality_model.learn(documents, table(spark, folder, "labels"), fold_of != 0)
    held_out = F.coalesce(fold_of == 0, F.lit(False))
    return quality_model.quality_scores(documents, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", "n_slots")


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_best_fit_packing, op2_minhash_near_dedup, op3_secret_scan, op4_quality_rules, op5_document_fingerprints,
        op6_mix_sources, op7_warc_archives, op8_line_dedup, op9_toxicity, op10_language_id, op11_merkle_manifest,
        op12_conversation_trie, op13_quality_classifier, pipeline,
    )
    return {query.__name__: query for query in found}
