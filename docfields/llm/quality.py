"""Quality rules as a short-circuit cascade.

A rule is a condition on measures of a text. On a bounded sample every rule's cost and the share of documents it
rejects are measured; the cascade then tests the rule with the most rejections per second first and evaluates
the next one only for documents that passed (``CASE WHEN`` stops at the first hit). The verdict is the
conjunction of all rules, so the order changes the cost and never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.llm.common import NO_GAP, let, words

SYMBOLS = "#*$%&|<>"
WINDOW = 3
# The documents on which costs and rejections are estimated (expected number).
SAMPLE_DOCUMENTS = 2000


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.array_join(words(text), "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{SYMBOLS}]++", "")).cast("long")


def _lines_with_words(text: Column) -> Column:
    split = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.filter(split, lambda line: line.rlike(NO_GAP))


def n_lines(text: Column) -> Column:
    return F.size(_lines_with_words(text)).cast("long")


def n_dup_lines(text: Column) -> Column:
    return let(_lines_with_words(text), lambda found: F.size(found) - F.size(F.array_distinct(found))).cast("long")


# Words in repeated windows. Most texts repeat none, which their windows' hashes show in one pass. Otherwise the windows
# are sorted by hash and place, so that equal ones become neighbours: n log n for a text of any length.


def _windows(found: Column) -> Column:
    """A 64-bit hash for each window of three words; the last two words begin none."""
    zipped = F.arrays_zip(*[F.slice(found, F.lit(1 + k), F.greatest(F.size(found) - (WINDOW - 1), F.lit(0))) for k in range(WINDOW)])
    return F.transform(zipped, lambda window: F.xxhash64(window))


def _repeated(windows: Column) -> Column:
    def of_pairs(pairs: Column) -> Column:
        same = F.filter(
            pairs, lambda p, i: (p["hash"] == F.get(pairs, i - 1)["hash"]) | (p["hash"] == F.get(pairs, i + 1)["hash"])
        )
        return let(F.sort_array(F.transform(same, lambda p: p["place"])), covered)

    def covered(places: Column) -> Column:
        """Three words for each window, less those that the next window covers as well."""
        steps = F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("hash"), i.alias("place"))))
    none = F.size(F.array_distinct(windows)) == F.size(windows)
    return F.when(none, F.lit(0)).otherwise(let(pairs, of_pairs)).cast("long")


def n_repeat_words(text: Column) -> Column:
    """Words that lie in a window of three words which the text has at least twice."""
    return let(_windows(words(text)), _repeated)


def wordlike(text: Column) -> Column:
    """Words with at least one letter."""
    return _wordlike(words(text))


def _wordlike(found: Column) -> Column:
    return F.size(F.filter(found, lambda w: w.rlike(r"\p{L}"))).cast("long")


MEASURES: dict[str, Callable[[Column], Column]] = {
    "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines,
    "n_repeat_words": n_repeat_words, "n_lines": n_lines, "wordlike": wordlike,
}


class Rule(NamedTuple):
    """Rejects a text if ``rejects`` holds; it is given a function from a measure's name to its column."""

    name: str
    rejects: Callable[[Callable[[str], Column]], Column]


BASE_RULES = (
    Rule("too_short", lambda m: m("n_words") < 50),
    Rule("repetitive", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
)
RULES = (
    *BASE_RULES,
    Rule("word_length", lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 20 * m("n_words"))),
    Rule("symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule("repeated_lines", lambda m: 10 * m("n_dup_lines") > 3 * m("n_lines")),
    Rule("not_words", lambda m: 10 * m("wordlike") < 7 * m("n_words")),
)


def _measure(text: Column, known: Mapping[str, Column]) -> Callable[[str], Column]:
    return lambda name: known[name] if name in known else MEASURES[name](text)


class Estimate(NamedTuple):
    rule: Rule
    seconds: float
    rejected: int


def order_rules(documents: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> list[Estimate]:
    """The rules by rejections per second on a sample, best first; rules that reject nothing come last, cheapest first.

    Only the sample is cached, and it holds about ``SAMPLE_DOCUMENTS`` texts however many documents there are.
    """
    fraction = min(1.0, SAMPLE_DOCUMENTS / max(1, documents.count()))
    sample = documents.select(F.col(f"`{text}`").alias("text")).sample(fraction=fraction, seed=1).cache()
    try:
        sample.count()
        found = []
        for rule in rules:
            start = time.perf_counter()
            rejected = sample.agg(F.count_if(rule.rejects(_measure(F.col("text"), {})))).first()[0]
            found.append(Estimate(rule, time.perf_counter() - start, rejected or 0))
    finally:
        sample.unpersist()
    return sorted(found, key=lambda e: (-e.rejected / e.seconds, e.seconds))


def first_failure(
    rules: Sequence[Rule], text: Column | None = None, known: Mapping[str, Column] | None = None
) -> Column:
    """The name of the first rule, in the given order, that rejects a text; null for a text that all rules keep.

    ``known`` holds measures that are columns already; others are computed from the text, and only where the
    cascade gets to their rule.
    """
    measure = _measure(text if text is not None else F.lit(None).cast("string"), known or {})
    verdict = F
    for rule in rules:
        verdict = verdict.when(rule.rejects(measure), F.lit(rule.name))
    return verdict.otherwise(F.lit(None).cast("string"))


def cascade(documents: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """All rows and columns of ``documents`` plus ``failed_rule``, replacing a column of that name.

    Null, empty and blank texts have no words and fail as too short; texts may have any length; repeated rows
    are judged alike; without rows the result is empty.
    """
    ordered = [e.rule for e in order_rules(documents, rules, text)]
    return documents.withColumn("failed_rule", first_failure(ordered, F.col(f"`{text}`")))


def assess(documents: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, the five base measures, base_failed and the cascade's verdict ``kept`` for every document.

    The base measures are wanted for every document, so the cascade reads them as columns; its further measures
    are computed only for documents that reach their rules.
    """
    ordered = [e.rule for e in order_rules(documents, rules)]
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    split = documents.select("doc_id", "text", words(F.col("text")).alias("words"))
    windows = split.withColumn("windows", _windows(F.col("words")))
    measured = windows.select(
        "doc_id", "text", "words", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        n_symbols(F.col("text")).alias("n_symbols"), n_dup_lines(F.col("text")).alias("n_dup_lines"),
        _repeated(F.col("windows")).alias("n_repeat_words"),
    )
    known = {name: F.col(name) for name in base} | {"wordlike": _wordlike(F.col("words"))}
    base_failed = F.greatest(*[rule.rejects(lambda name: known[name]) for rule in BASE_RULES])
    kept = first_failure(ordered, F.col("text"), known).isNull()
    return measured.select("doc_id", *base, base_failed.alias("base_failed"), kept.alias("kept"))
