import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docfields.llm import language
from docfields.llm.common import fold
from tests_llm_help import ODD_ROWS, rows_of

SYLLABLES = {"aa": ("ka", "lo", "mi", "ru"), "bb": ("ßen", "üch", "sch", "keit"), "cc": ("ción", "ñar", "que", "lo")}


def text(lang, seed, words):
    chooser = random.Random(f"{lang}{seed}")
    return " ".join("".join(chooser.choice(SYLLABLES[lang]) for _ in range(chooser.randrange(1, 4))) for _ in range(words)).capitalize()


def slow_phrases(words, learned):
    count, at = 0, 0
    while at < len(words):
        end = at + 1
        while end < len(words) and words[at : end + 1] in learned:
            end += 1
        count, at = count + 1, end
    return count


def test_automaton_accepts_the_factors_and_nothing_else():
    chooser = random.Random(2)
    for _ in range(30):
        whole = [chooser.randrange(3) for _ in range(chooser.randrange(1, 25))]
        states = language.suffix_automaton(whole)
        factors = {tuple(whole[i:j]) for i in range(len(whole)) for j in range(i, len(whole) + 1)}
        for _ in range(200):
            tried = tuple(chooser.randrange(3) for _ in range(chooser.randrange(1, 7)))
            state = 0
            for symbol in tried:
                state = states[state].get(symbol) if state is not None else None
            assert (state is not None) == (tried in factors)


def test_phrases_equal_brute_force():
    model = language.Model(("aa", "bb"), tuple(language.normal(text(lang, 0, 60)) for lang in ("aa", "bb")))
    texts = [text("aa", 1, 20), text("bb", 1, 30), "x", "Kalo1ßen", None, "", "12 !", "漢字 ka"]
    letters, bits = language.Parser(model).entropies(texts)
    for i, t in enumerate(texts):
        words = "".join(c if c.isalpha() else " " for c in (t or "").lower())
        words = " ".join(words.split()) + (" " if words.rstrip() != words and words.strip() else "")
        assert letters[i] == sum(c.isalpha() for c in t or "")
        if not letters[i]:
            continue
        for k, learned in enumerate(model.texts):
            assert bits[i, k] == pytest.approx(slow_phrases(words, learned) * np.log2(len(learned) + 1) / len(words))


def test_blocks_add_at_most_one_phrase_each(monkeypatch):
    model = language.Model(("aa", "bb"), tuple(language.normal(text(lang, 0, 200)) for lang in ("aa", "bb")))
    long = text("aa", 3, 3000)
    whole = slow_phrases(language.normal(long).strip(), model.texts[0])
    bits = language.Parser(model).entropies([long])[1][0, 0]
    count = bits * len(language.normal(long).strip()) / np.log2(len(model.texts[0]) + 1)
    assert whole <= round(count) <= whole + len(long) // language.BLOCK + 1


def corpus(spark):
    rows = [(i, text(lang := tuple(SYLLABLES)[i % 3], i, 3 + i % 60), lang) for i in range(450)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def model(spark):
    return language.learn(corpus(spark), fold(F.col("doc_id"), 3) != 1)


def test_held_out_documents(spark, model):
    table = corpus(spark)
    found = language.identify(table, model).join(table, "doc_id").filter(fold(F.col("doc_id"), 3) == 1).collect()
    assert len(found) > 100
    assert sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_labels_of_the_held_out_fold_are_not_used(spark, model):
    held_out = fold(F.col("doc_id"), 3) == 1
    turned = corpus(spark).withColumn("lang", F.when(held_out, "other").otherwise(F.col("lang")))
    assert language.learn(turned, ~held_out) == model


def test_odd_rows(odd, clashing, nothing, model):
    found = language.identify(odd, model)
    assert found.count() == len(ODD_ROWS)
    assert {r.lang_pred for r in found.collect() if r.doc_id in (1, 2, 3)} == {"und"}
    assert rows_of(found) == rows_of(language.identify(clashing, model))
    assert language.identify(nothing, model).count() == 0
    empty = language.learn(nothing, F.lit(True))
    assert {(r.lang_pred, r.score) for r in language.identify(odd, empty).collect()} == {("und", 0.0)}
    learned = language.learn(odd, F.lit(True))
    assert set(learned.languages) == {"en", "de", "fr"}
    assert language.identify(odd, learned).count() == len(ODD_ROWS)
