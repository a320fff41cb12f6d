"""What several operators share: words, folds, stored intermediate tables."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.session import fresh_path

# The characters between words; every other character belongs to a word.
GAP = r"[\x20\x09-\x0D]"
NO_GAP = r"[^\x20\x09-\x0D]"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers, unless the environment already has it on their path."""
    root, application = Path(__file__).resolve().parents[2], spark.sparkContext.applicationId
    if application in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    package = Path(__file__).resolve().parents[1].name
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="ship-"), package), "zip", root, package)
    spark.sparkContext.addPyFile(archive)
    _shipped.add(application)


def map_arrow(frame: DataFrame, function: Callable, schema) -> DataFrame:
    """``mapInArrow`` with this package at hand."""
    ship(frame.sparkSession)
    return frame.mapInArrow(function, schema)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over one evaluation of ``value``, also where ``body`` uses it inside a loop of its own."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text in order; an empty array for a null, an empty or a blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{GAP}+"), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def share(doc_id: Column, salt: str) -> Column:
    """A number in [0, 1) that depends on the id alone: the deterministic choice of bounded samples."""
    return F.pmod(F.xxhash64(F.lit(salt), doc_id.cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The rows of ``frame``, written to the shared folder and read back.

    The written table cuts the lineage, survives lost executors, and gives the planner its true size.
    """
    spark = frame.sparkSession
    path = fresh_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
