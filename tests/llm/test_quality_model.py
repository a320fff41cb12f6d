import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docfields.llm import quality_model
from docfields.llm.common import fold
from tests_llm_help import ODD_ROWS, prose


def test_sum_of_squares_identity_equals_all_pairs():
    chooser = np.random.default_rng(3)
    width = quality_model.DIM + len(quality_model.DENSE)
    model = quality_model.Model(0.3, chooser.normal(size=width).astype(np.float32),
                                chooser.normal(size=(width, quality_model.FACTORS)).astype(np.float32),
                                np.zeros(len(quality_model.DENSE)), np.ones(len(quality_model.DENSE)))
    index, value = quality_model._full(*quality_model.features("the cat sat on the mat\nok", 25), model)
    pairs = sum(float(model.factors[i] @ model.factors[j]) * value[a] * value[b]
                for (a, i), (b, j) in itertools.combinations(enumerate(index), 2))
    expected = model.bias + float(model.linear[index] @ value) + pairs
    assert quality_model.raw_score(index, value, model) == pytest.approx(expected, rel=1e-4, abs=1e-4)


def labelled(n):
    good = [prose(i, 60 + i % 40).capitalize() + "." for i in range(n)]
    bad = ["$$$ " * (i % 5 + 1) + " ".join(["CLICK", "HERE", "!!!", "|"] * (3 + i % 4)) for i in range(n)]
    rows = [(i, text, None, None, len(text)) for i, text in enumerate(good + bad)]
    labels = [(i, int(i < n), 0) for i in range(2 * n)]
    return rows, labels


def test_held_out_accuracy_and_reruns(spark):
    rows, labels = labelled(150)
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    learn_from = fold(F.col("doc_id"), 5) != 0
    model = quality_model.learn(documents, table, learn_from)
    first = {r.doc_id: r for r in quality_model.quality_scores(documents, model).collect()}
    again = {r.doc_id: r.score for r in quality_model.quality_scores(documents, quality_model.learn(documents, table, learn_from)).collect()}
    assert again == {k: r.score for k, r in first.items()}
    held = [k for k in first if zlib.crc32(str(k).encode()) % 5 == 0]
    right = sum(first[k].predicted == int(k < 150) for k in held)
    assert len(held) > 30 and right / len(held) >= 0.95
    assert all(0.0 <= r.score <= 1.0 and r.predicted == int(r.score >= 0.3) for r in first.values())


def test_odd_rows(spark, odd, clashing, nothing):
    labels = spark.createDataFrame([(r[0], i % 2, 0) for i, r in enumerate(ODD_ROWS)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_model.learn(odd, labels, F.lit(True))
    found = quality_model.quality_scores(clashing, model).collect()
    assert len(found) == len(ODD_ROWS) and all(0.0 <= r.score <= 1.0 for r in found)
    same = [r.score for r in found if r.doc_id == 4]
    assert len(same) == 2 and same[0] == same[1]
    assert quality_model.quality_scores(nothing, model).count() == 0
    empty = quality_model.learn(nothing, labels.limit(0), F.lit(True))
    assert len({r.score for r in quality_model.quality_scores(odd, empty).collect()}) == 1
