import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docfields.llm import line_dedup, packing
from docfields.llm.common import stored
from tests_llm_help import SCHEMA, prose, rows_of
from test_near_dup import brute_classes

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def steps(spark):
    """The documents, and what each stage makes of them."""
    found = [spark.read.parquet(f"{FOLDER}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        found.append(stored(stage(spark, found[-1], FOLDER), f"test-{name}"))
    return found


def test_columns(steps):
    assert all(step.columns == steps[0].columns for step in steps[:-1])
    assert corpus_pipeline.ORACLE_SQL is None
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_toxicity_drops_whole_rows(steps):
    documents, kept = {tuple(r) for r in steps[0].collect()}, {tuple(r) for r in steps[1].collect()}
    # So few labels may not tell anything toxic; the operator's own tests have more.
    assert kept <= documents and len(kept) > 0.8 * len(documents)


def test_few_labels_still_drop_toxic_documents(steps):
    assert steps[1].count() < steps[0].count()


def test_lines_of_sites(steps):
    expected = {r.doc_id: r.cleaned.text for r in line_dedup.drop_boilerplate(steps[1], F.col("source")).collect()}
    assert {r.doc_id: r.text for r in steps[2].collect()} == expected
    assert all(r.n_chars == len(r.text) for r in steps[2].collect())


def test_one_of_each_class(steps):
    classes = brute_classes([(r.doc_id, r.text) for r in steps[2].collect()])
    assert {r.doc_id for r in steps[3].collect()} == {i for i, c in classes.items() if i == c}
    assert steps[3].count() < steps[2].count()


def test_mix_keeps_to_its_budget(steps):
    def words(table):
        return sum(len((r.text or "").encode().split()) for r in table.collect())

    longest = max(len(r.text.split()) for r in steps[3].collect())
    assert 0 <= words(steps[3]) - words(steps[4]) <= 20 * longest
    assert {tuple(r) for r in steps[4].collect()} <= {tuple(r) for r in steps[3].collect()}


def test_everything_is_packed(steps):
    rows = steps[5].collect()
    assert sum(r.length for r in rows) == sum(len((r.text or "").encode().split()) for r in steps[4].collect())
    assert max(r.length for r in rows) <= max(packing.CAPACITIES)


def test_run_equals_the_stages(spark, steps):
    assert rows_of(corpus_pipeline.run(spark, FOLDER)) == rows_of(steps[5])


def test_a_text_with_many_copies_stays_once(spark):
    texts = [prose(1, 60) + "\n" + prose(2, 60)] * 30 + [f"menu home\n{prose(i, 60)}" for i in range(30, 60)]
    table = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], SCHEMA)
    cleaned = stored(corpus_pipeline.drop_boilerplate_lines(spark, table, FOLDER), "test-copies")
    kept = corpus_pipeline.keep_one_of_each(spark, cleaned, FOLDER).collect()
    assert [r.doc_id for r in kept if r.text == texts[0]] == [0] and len(kept) == 31
    assert not any("menu home" in r.text or not r.text for r in kept)


def test_stages_take_odd_tables(spark, clashing, nothing):
    for table in (clashing, nothing):
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, table, FOLDER)
            assert found.count() <= 3 * max(1, table.count()) + 20, name
            if name != "best_fit_packing":
                assert found.columns == table.columns, name
