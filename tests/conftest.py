import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from docfields.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def read_text(spark):
    """Extract and check a few literal texts; gives one row per text in order."""
    from docfields.operators.extract import extract
    from docfields.operators.validate import check

    def run(*texts):
        table = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
        return check(extract(table)).orderBy("doc_id").collect()

    return run
