"""Helpers of the tests in this folder."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [a + b for a in ("ka", "lo", "mi", "ru", "te", "va", "zo") for b in ("ba", "de", "fi", "go", "hu", "na", "pe")]


def prose(seed, words):
    chooser = random.Random(seed)
    return " ".join(chooser.choice(VOCABULARY) for _ in range(words))


ODD_ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t ", "en", "a", 4),
    (4, "one two three four five six", "en", "a", 27),
    (4, "one two three four five six", "en", "a", 27),
    (None, "one two three four five six", "en", None, 27),
    (None, None, None, "b", None),
    (5, "same line\n\nsame line\nsame line", "de", "b", 31),
    (6, prose(6, 30_000), "fr", "b", None),
    (7, "é" * 10 + " ünï çödé 漢字 🙂   ", "de", "c", 20),
    (8, "one two three four five six", None, "c", 27),
]


def rows_of(table):
    """All rows, in an order of their own."""
    return sorted((tuple(row) for row in table.collect()), key=repr)
