"""A training corpus from raw documents, stage by stage.

Every stage takes all that its predecessor kept, and its decisions take effect: toxic documents go, boilerplate
lines go from the texts, one document of each group of near-duplicates stays, every source comes near its target
(documents may repeat), and the rest is packed into bins. All stages but the last return the columns of
``documents``; each result is written as Parquet and read again as the next one's documents.

No statement: segment scores, exact near-duplicate classes and best-fit packing are no SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.llm import line_dedup, mixing, near_dup, packing, toxicity
from docfields.llm.common import stored, table
from docfields.llm.queries import toxicity_model

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return toxicity.without_toxic(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate of their source; n_chars follows the text.

    Copies of a text count once, or the lines of a text with many copies would all go, in every copy.
    """
    into = "cleaned"
    while into in docs.columns:
        into += "_"
    cleaned = line_dedup.drop_boilerplate(docs, F.col("source"), into=into, copies_once=True)
    changed = F.col(f"{into}.n_dropped") > 0
    new = {
        "text": F.col(f"{into}.text"),
        "n_chars": F.when(changed, F.length(f"{into}.text").cast("long")).otherwise(F.col("n_chars")),
    }
    return cleaned.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dup.one_of_each(docs)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.repeated(docs)


def pack_into_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("minhash_near_dedup", keep_one_of_each),
    ("mixing", mix_to_targets),
    ("best_fit_packing", pack_into_bins),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents`` to the packed pieces."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
