import hashlib

import pytest
from pyspark.sql import functions as F

from docfields.llm import merkle
from tests_llm_help import ODD_ROWS, prose, rows_of


def trees(spark, *texts):
    table = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r[0] for r in table.orderBy("i").select(merkle.fingerprint(F.col("text"))).collect()]


def test_equal_texts_and_only_those_have_equal_roots(spark):
    texts = ["a b", "a  b", "a b ", "a\nb", "a\n\nb", "a\n \nb", "", None, "a b"]
    found = trees(spark, *texts)
    assert found[0] == found[-1] and found[6] == found[7]
    assert len({t.split("/")[0] for t in found}) == 7


def test_likeness_and_differing_branches(spark):
    parts = [prose(i, 40) for i in range(4)]
    before, after = "\n\n".join(parts), "\n\n".join([*parts[:2], prose(9, 40), parts[3]])
    table = spark.createDataFrame([(before, after)], "a string, b string").select(
        merkle.fingerprint(F.col("a")).alias("a"), merkle.fingerprint(F.col("b")).alias("b"))
    row = table.select(
        merkle.likeness(F.col("a"), F.col("b")), merkle.likeness(F.col("a"), F.col("a")),
        merkle.differing_sections(F.col("a"), F.col("b")), merkle.differing_sections(F.col("a"), F.col("a"))).first()
    assert row[0] == pytest.approx(15 / 25) and row[1] == 1.0 and row[2] == [2] and row[3] == []


def expected_neighbours(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    found = []
    for i, (doc_id, text) in enumerate(ordered):
        text, following = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        found.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    return sorted(found, key=repr)


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_neighbours_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(merkle, "BLOCK_DOCUMENTS", block)
    rows = [(i * i % 101, prose(i, 3 + i % 9)) for i in range(40)]
    rows = list({r[0]: r for r in rows}.values()) + [r[:2] for r in ODD_ROWS if r[0] not in (4, None)]
    found = merkle.neighbours(spark.createDataFrame(rows, "doc_id long, text string"))
    keys = ("doc_id", "n_chars", "edited_sha256")
    assert sorted((tuple(r[k] for k in keys) for r in found.collect()), key=repr) == expected_neighbours(rows)


def test_edited_texts_stay_nearer_than_neighbours(spark):
    rows = [(i, prose(i, 200)) for i in range(30)]
    for r in merkle.neighbours(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.near_edited > 0.25 > r.near_next


def test_odd_rows(spark, odd, clashing, nothing):
    found = merkle.neighbours(odd)
    assert found.count() == odd.count()
    assert rows_of(found) == rows_of(merkle.neighbours(clashing))
    assert merkle.neighbours(nothing).count() == 0
    alone = merkle.neighbours(spark.createDataFrame([(3, "a b c d")], "doc_id long, text string")).first()
    assert alone.n_chars == 7 and alone.edited_sha256 == hashlib.sha256(b"a ba b").hexdigest() or alone.near_next == 1.0


def test_the_plan_is_free_of_python(odd):
    plan = merkle.neighbours(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("Exchange") == 1
