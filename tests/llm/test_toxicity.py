import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docfields.llm import toxicity
from docfields.llm.common import fold
from tests_llm_help import ODD_ROWS, prose, rows_of


def slow_segments(scores):
    """The definition: the best segment, then the same to its left and right, while scores are positive."""
    def best(low, high):
        top = None
        for i in range(low, high):
            total = 0.0
            for j in range(i, high):
                total += scores[j]
                # Of equal sums the shortest; segments neither start nor end with what adds nothing.
                if total > 1e-12 and (top is None or total > top[0] + 1e-9 or (abs(total - top[0]) < 1e-9 and j + 1 - i < top[2] - top[1])):
                    top = (total, i, j + 1)
        return top

    def all_of(low, high):
        top = best(low, high)
        return [] if top is None else [*all_of(low, top[1]), top, *all_of(top[2], high)]

    return all_of(0, len(scores))


@pytest.mark.parametrize("seed", range(40))
def test_segments_equal_brute_force(seed):
    chooser = random.Random(seed)
    scores = [chooser.choice((-3, -1, -0.5, 0.7, 1.3, 4)) + seed * 1e-4 * chooser.random() for _ in range(chooser.randrange(1, 40))]
    found = toxicity.segments(np.array(scores))
    expected = slow_segments(scores)
    assert [(a, b) for _, a, b in found] == [(a, b) for _, a, b in expected]
    assert [s for s, _, _ in found] == pytest.approx([s for s, _, _ in expected])


def corpus(spark, seed=0, count=600):
    chooser = random.Random(seed)
    rows = []
    for i in range(count):
        toxic = i % 6 == 0
        words = prose(i + 5000 * seed, 30 + i % 90).split()
        for _ in range(3 if toxic else 0):
            words.insert(chooser.randrange(len(words)), chooser.choice(("nasty", "vileword", "grrr" + chooser.choice("abcdefghij") + "ix")))
        rows.append((i, " ".join(words), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


@pytest.fixture(scope="module")
def model(spark):
    table = corpus(spark)
    return toxicity.learn(table.select("doc_id", "text"), table.select("doc_id", "toxic"), fold(F.col("doc_id"), 5) != 0)


def test_held_out_documents(spark, model):
    table = corpus(spark)
    found = toxicity.toxicity(table, model).join(table, "doc_id").filter(fold(F.col("doc_id"), 5) == 0).collect()
    assert len(found) > 50
    assert sum(r.predicted == r.toxic for r in found) >= 0.97 * len(found)
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.predicted:
            words = toxicity.tokens(r.text)
            for passage in r.passages:
                assert any(w.startswith(("nasty", "vileword", "grrr")) for w in words[passage.start : passage.end])


def test_unseen_words_fall_back_to_their_stem(model):
    assert toxicity.token_score("grrrzzzz", model) > 0 > toxicity.token_score("kabafi", model)


def test_labels_of_the_held_out_fold_are_not_used(spark, model):
    table = corpus(spark)
    turned = table.withColumn("toxic", F.when(fold(F.col("doc_id"), 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.learn(table.select("doc_id", "text"), turned.select("doc_id", "toxic"), fold(F.col("doc_id"), 5) != 0)
    assert again == model


def test_filter_keeps_rows_as_they_are(spark, model):
    table = corpus(spark, seed=1).withColumn("score", F.lit("other"))
    kept = toxicity.without_toxic(table, model)
    assert kept.schema == table.schema
    clean = table.filter("toxic = 0")
    assert clean.count() - kept.filter("toxic = 0").count() <= 3 and kept.filter("toxic = 1").count() <= 10


def test_odd_rows(spark, odd, clashing, nothing, model):
    assert rows_of(toxicity.toxicity(odd, model)) == rows_of(toxicity.toxicity(clashing, model))
    assert toxicity.toxicity(odd, model).count() == len(ODD_ROWS)
    assert toxicity.toxicity(nothing, model).count() == 0
    assert toxicity.without_toxic(clashing, model).columns == clashing.columns
    labels = spark.createDataFrame([], "doc_id long, toxic long")
    empty = toxicity.learn(nothing, labels, F.lit(True))
    assert {r.predicted for r in toxicity.toxicity(odd, empty).collect()} == {0}
    one_kind = spark.createDataFrame([(6, 0), (7, 0), (7, None), (None, 1)], "doc_id long, toxic long")
    assert {r.predicted for r in toxicity.toxicity(odd, toxicity.learn(odd, one_kind, F.lit(True))).collect()} == {0}


@pytest.mark.parametrize("every, count", [(7, 70), (2, 40)])
def test_few_labels_and_balanced_ones_tell_toxic_documents(spark, every, count):
    rows = [(i, prose(i, 40) + (" vileword vileword nasty" if i % every == 0 else ""), int(i % every == 0)) for i in range(count)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(table.select("doc_id", "text"), table.select("doc_id", "toxic"), F.lit(True))
    new = spark.createDataFrame([(0, prose(900, 40) + " vileword vileword nasty"), (1, prose(901, 40))], "doc_id long, text string")
    assert [r.predicted for r in toxicity.toxicity(new, model).orderBy("doc_id").collect()] == [1, 0]


def test_chance_of_a_class_is_the_binomial_tail(spark):
    found = spark.range(1).select(*[toxicity.surprise(F.lit(n), F.lit(k), b) for n, k, b in ((4, 4, 0.25), (9, 0, 0.5), (10, 2, 0.2))]).first()
    assert list(found) == pytest.approx([4 * np.log(4), 9 * np.log(2), 0.0])
