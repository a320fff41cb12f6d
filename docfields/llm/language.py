"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built over labelled text. A text is parsed from left to right into the
longest phrases that occur in the language's text; a language whose text resembles it needs few phrases (the cross-parsing
of Ziv and Merhav). The number of phrases times the bits that one phrase costs (the logarithm of the length of
the labelled text), divided by the length of the text, estimates the cross entropy. The least one wins.

All texts of a batch are parsed at once: the automata are one transition table, and each numpy step advances one
letter in every block of every text and in every language. Texts are cut into blocks of ``BLOCK`` letters for that
(one more phrase per block, the same for all languages), so a long text is whole, only parsed in parallel.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.llm.common import map_arrow, share

# Bounds of the model: letters of labelled text for a language and in all, documents to take them from (expected), letters
# from one document, and languages (the most frequent labels).
LETTERS = 32_768
ALL_LETTERS = 262_144
LEARNING_DOCUMENTS = 400
LETTERS_OF_DOCUMENT = 1024
LANGUAGES = 512
BLOCK = 1024
# Letters that are parsed together.
BATCH_LETTERS = 4_000_000

UNDETERMINED = "und"


class Model(NamedTuple):
    """Labelled text by language; the automata are built from it once in every worker."""

    languages: tuple[str, ...]
    texts: tuple[str, ...]


def normal(text: str) -> str:
    """Lower-case letters, each run of other characters one space, one space at either end."""
    return " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts every factor of a sequence (Blumer et al., online construction)."""
    following: list[dict[int, int]] = [{}]
    longest, link, last = [0], [-1], 0
    for symbol in symbols:
        state = len(following)
        following.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in following[at]:
            following[at][symbol] = state
            at = link[at]
        if at >= 0:
            target = following[at][symbol]
            if longest[target] == longest[at] + 1:
                link[state] = target
            else:
                copy = len(following)
                following.append(dict(following[target]))
                longest.append(longest[at] + 1)
                link.append(link[target])
                link[target] = link[state] = copy
                while at >= 0 and following[at].get(symbol) == target:
                    following[at][symbol] = copy
                    at = link[at]
        last = state
    return following


class Parser:
    """The automata of all languages as one table; row 0 is the dead state."""

    def __init__(self, model: Model) -> None:
        self.model = model
        letters = sorted(set("".join(model.texts)) - {" "})
        self.unknown = len(letters) + 1
        self.width = len(letters) + 2
        self.symbols = np.zeros(0x110000, dtype=np.int16)
        self.symbols[[i for i in range(0x110000) if chr(i).isalpha()]] = self.unknown
        for place, letter in enumerate(letters):
            self.symbols[ord(letter)] = place + 1
        automata = [suffix_automaton(self.symbols[[ord(c) for c in text]].tolist()) for text in model.texts]
        self.roots = np.cumsum([1, *[len(a) for a in automata]])[:-1]
        self.table = np.zeros((1 + sum(map(len, automata)), self.width), dtype=np.int32)
        for offset, automaton in zip(self.roots, automata, strict=True):
            for state, transitions in enumerate(automaton):
                for symbol, target in transitions.items():
                    self.table[offset + state, symbol] = offset + target
        # By symbol and language: the state after a phrase's first letter. A letter that a language does not have is a phrase
        # of its own and leads to the dead state, from which any letter begins a new phrase.
        self.first = self.table[self.roots].T.copy()
        self.bits = np.log2([len(text) + 1 for text in model.texts])

    def _parse(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases by block and language; blocks come in descending order of their length."""
        table, width, first = self.table.ravel(), self.width, self.first
        state = np.zeros((len(starts), len(self.roots)), dtype=np.int32)
        phrases = np.zeros(state.shape, dtype=np.int32)
        active = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left")
        for place, k in enumerate(active):
            symbol = flat[starts[:k] + place]
            reached = table[state[:k].astype(np.int64) * width + symbol[:, None]]
            missed = reached == 0
            phrases[:k] += missed
            state[:k] = np.where(missed, first[symbol], reached)
        return phrases

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Letters of every text (with the spaces between words), and bits per letter by language."""
        lowered = [(text or "").lower() for text in texts]
        codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        symbols = self.symbols[codes]
        owner = np.repeat(np.arange(len(texts)), [len(text) for text in lowered])
        # One space after every word; other characters that are no letters go.
        begins = np.ones(len(symbols), dtype=bool)
        begins[1:] = owner[1:] != owner[:-1]
        before = np.concatenate(([0], symbols[:-1])) if len(symbols) else symbols
        keep = (symbols != 0) | ((before != 0) & ~begins)
        symbols, owner = symbols[keep], owner[keep]
        counts = np.bincount(owner, minlength=len(texts))
        offsets = np.concatenate(([0], np.cumsum(counts)))[:-1]
        blocks = -(-counts // BLOCK)
        document = np.repeat(np.arange(len(texts)), blocks)
        number = np.arange(len(document)) - np.repeat(np.concatenate(([0], np.cumsum(blocks)))[:-1], blocks)
        starts = offsets[document] + number * BLOCK
        lengths = np.minimum(BLOCK, counts[document] - number * BLOCK)
        order = np.argsort(-lengths, kind="stable")
        phrases = np.zeros((len(texts), len(self.model.languages)))
        np.add.at(phrases, document[order], self._parse(symbols, starts[order], lengths[order]))
        letters = np.bincount(owner[symbols != 0], minlength=len(texts))
        return letters, phrases * self.bits / np.maximum(counts, 1)[:, None]


_parsers: dict[Model, Parser] = {}


def parser(model: Model) -> Parser:
    """The model's parser, built once in a worker."""
    if model not in _parsers:
        _parsers.clear()
        _parsers[model] = Parser(model)
    return _parsers[model]


def learn(documents: DataFrame, admitted: Column) -> Model:
    """Labelled text from about ``LEARNING_DOCUMENTS`` documents of every language that ``admitted`` (over doc_id) lets in.

    The choice depends on the ids alone. A language is a non-null label; the bounds above hold for what reaches the driver.
    """
    usable = documents.filter(admitted & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return Model((), ())
    rates = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, LEARNING_DOCUMENTS / r["count"]))])
    each = min(LETTERS, ALL_LETTERS // len(counts))
    letters = F.substring(F.regexp_replace(F.lower(F.col("text")), r"[^\p{L}]+", " "), 1, LETTERS_OF_DOCUMENT)
    rows = usable.filter(share(F.col("doc_id"), "language") < F.try_element_at(rates, F.col("lang"))).select(
        "lang", share(F.col("doc_id"), "order").alias("place"), letters.alias("letters")
    ).collect()
    gathered: dict[str, str] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["place"], r["letters"])):
        text = gathered.get(row["lang"], "")
        if len(text) < each:
            gathered[row["lang"]] = (text.rstrip() + normal(row["letters"]))[:each]
    found = {lang: text for lang, text in gathered.items() if text.strip()}
    return Model(tuple(found), tuple(found.values()))


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row.

    The score is the share by which the winner's entropy is below the second one's (1 with a single language). A
    null, empty or letterless text is undetermined with score 0; of equal entropies the first language in order
    wins, with score 0; texts may have any length; other columns are not read; no rows give no rows. A model without languages gives ``und``.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def batch_results(texts: list[str | None]) -> tuple[list[str], list[float]]:
        model = shared.value
        if not model.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        letters, bits = parser(model).entropies(texts)
        ranked = np.sort(bits, axis=1)
        second = ranked[:, 1] if bits.shape[1] > 1 else np.full(len(texts), math.inf)
        with np.errstate(invalid="ignore", divide="ignore"):
            margin = np.where(np.isinf(second), 1.0, (second - ranked[:, 0]) / second)
        best = np.argmin(bits, axis=1)
        known = letters > 0
        return (
            [model.languages[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)],
            np.where(known, margin, 0.0).tolist(),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found: list[str] = []
            scores: list[float] = []
            group: list[str | None] = []
            size = 0
            for text in texts:
                group.append(text)
                size += len(text or "")
                if size >= BATCH_LETTERS:
                    for whole, part in zip((found, scores), batch_results(group), strict=True):
                        whole.extend(part)
                    group, size = [], 0
            if group:
                for whole, part in zip((found, scores), batch_results(group), strict=True):
                    whole.extend(part)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_arrow(documents.select("doc_id", "text"), run, f"doc_id {kind}, lang_pred string, score double")
