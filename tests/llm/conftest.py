import pytest

from tests_llm_help import ODD_ROWS, SCHEMA


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    return spark.createDataFrame(ODD_ROWS, SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, odd):
    """The odd rows with extra columns named like columns that operators add or use inside."""
    from pyspark.sql import functions as F

    names = ("size", "slice", "digest", "words", "kept", "score", "predicted", "packed", "cleaned", "block", "tree", "class_id",
             "member", "bucket", "centre", "first_id", "shard", "bin", "target", "taken", "site", "drops", "line", "text ")
    return odd.select("*", *[F.lit(i).alias(name) for i, name in enumerate(names)])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
