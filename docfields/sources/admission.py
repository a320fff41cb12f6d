"""Which inputs are accepted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_admitted(name: Column) -> Column:
    """Whether a file name is present and ends in ``.pdf`` in any case; never NULL."""
    return F.coalesce(F.endswith(F.lower(name), F.lit(".pdf")), F.lit(False))


def admitted(files: DataFrame, name: str) -> DataFrame:
    return files.filter(is_admitted(F.col(name)))


def rejected(files: DataFrame, name: str) -> DataFrame:
    return files.filter(~is_admitted(F.col(name)))
