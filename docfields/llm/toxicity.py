"""Toxicity by maximum-scoring segments over token log-odds.

*Token scores.* A token has a chain of classes: its first three, four, five and six letters, then the whole word. The rate
of toxic documents in a class is smoothed by a Dirichlet prior with the mean of the class above, so rare words
lean on their stem and unseen ones fall back to it. A score is the log-odds of that rate against the overall
rate, less a fixed drift, which makes the scores of ordinary text negative on average.

*Passages.* One linear scan over a document finds all maximal scoring segments (Ruzzo and Tompa).

*Calibration.* Under the extreme-value law for segment scores, a text of n tokens has ``K n exp(-lambda S)`` segments
of score S or more by chance; lambda is the positive root of ``E[exp(lambda s)] = 1`` over the token scores of clean
documents (Karlin and Altschul). Segments with a small expected number are significant; a document's evidence is the
sum of their log-significances, and a logistic curve fitted on the learning documents turns it into a probability.

Learning uses a bounded sample of labelled documents; scoring reads whole texts, one batch at a time.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.llm.common import map_arrow, share, stored

# Bounds of the model: labelled documents to learn from (expected number; so many tasks read them), and classes kept.
LEARNING_DOCUMENTS = 20_000
SAMPLE_PARTS = 32
MODEL_CLASSES = 200_000
STEMS = (3, 4, 5, 6)
PRIOR = 10.0
DRIFT = 2.0
# Classes of fewer documents, or whose number of toxic documents chance explains, follow the class above. The test adapts to
# the documents and the toxic share: of all classes tested, about so many may pass by chance, and each with this chance at most.
MIN_DOCUMENTS = 4
CHANCE_CLASSES = 10
MAX_CHANCE = 0.05
MEMO_WORDS = 500_000
SIGNIFICANT = 0.05

_LETTERS = re.compile(r"[^\W\d_]+")


class Model(NamedTuple):
    """Scores by class (``stem*`` or ``word``), the score of any other token, and the calibration."""

    scores: dict[str, float]
    other: float
    decay: float
    scale: float
    intercept: float
    slope: float


def tokens(text: str | None) -> list[str]:
    """The runs of letters of a text in lower case."""
    return _LETTERS.findall(text.lower()) if text else []


def classes(word: str) -> list[str]:
    """The classes of a token from the widest to the word itself."""
    return [word[:n] + "*" for n in STEMS if len(word) > n] + [word]


def token_score(word: str, model: Model) -> float:
    """The score of the narrowest class that the model knows."""
    scores = model.scores
    found = scores.get(word)
    if found is not None:
        return found
    for n in reversed(STEMS):
        if len(word) > n:
            found = scores.get(word[:n] + "*")
            if found is not None:
                return found
    return model.other


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments as (score, start, end), end exclusive, in order (Ruzzo and Tompa, linear time).

    Only positive scores can start or end a segment; the runs between them enter as differences of running sums.
    """
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    kept: list[tuple[float, float, int, int]] = []  # sum before, sum after, start, end
    links: list[int] = []  # nearest earlier segment with a smaller sum before it
    for at in np.flatnonzero(scores > 0):
        segment = (float(sums[at]), float(sums[at + 1]), int(at), int(at) + 1)
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][0] >= segment[0]:
                j = links[j]
            if j < 0 or kept[j][1] >= segment[1]:
                kept.append(segment)
                links.append(j)
                break
            segment = (kept[j][0], segment[1], kept[j][2], segment[3])
            del kept[j:], links[j:]
    return [(after - before, start, end) for before, after, start, end in kept]


def evidence(found: Iterable[tuple[float, int, int]], n_tokens: int, decay: float, scale: float) -> float:
    """Sum of the log-significances of a document's significant segments."""
    total = 0.0
    for score, _, _ in found:
        surprise = decay * score - math.log(max(scale * n_tokens, 1e-12))
        if surprise > -math.log(SIGNIFICANT):
            total += surprise
    return total


def probability(value: float, model: Model) -> float:
    return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, model.intercept + model.slope * math.log1p(value)))))


class Scorer:
    """Scores texts with a model; remembers the scores of up to ``MEMO_WORDS`` words."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.memo: dict[str, float] = {}

    def token_scores(self, words: list[str]) -> np.ndarray:
        memo, model = self.memo, self.model
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for word in set(words):
            if word not in memo:
                memo[word] = token_score(word, model)
        return np.fromiter(map(memo.__getitem__, words), dtype=np.float64, count=len(words))

    def assess(self, text: str | None) -> tuple[float, list[tuple[float, int, int]]]:
        """Evidence and significant segments (score, first token, last token exclusive) of a text."""
        words = tokens(text)
        if not words:
            return 0.0, []
        found = segments(self.token_scores(words))
        model = self.model
        limit = (math.log(max(model.scale * len(words), 1e-12)) - math.log(SIGNIFICANT)) / model.decay
        return evidence(found, len(words), model.decay, model.scale), [s for s in found if s[0] > limit]


def learning_sample(documents: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """text and toxic of about ``LEARNING_DOCUMENTS`` labelled documents that ``learn`` (over doc_id) admits.

    The choice depends on the ids alone. The chosen labels are bounded, so they may be broadcast to the texts. Repeated
    labels of an id count as toxic if any does.
    """
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(
        learn & F.col("toxic").isin(0, 1)
    )
    fraction = min(1.0, LEARNING_DOCUMENTS / max(1, usable.count()))
    chosen = usable.filter(share(F.col("doc_id"), "toxicity") < fraction).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # Copies of a text are one piece of evidence.
    return stored(rows.dropDuplicates(["text"]).select("text", "toxic").repartition(SAMPLE_PARTS), "toxicity-sample")


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents and toxic documents by class, summed within each batch."""
    for batch in batches:
        total: Counter[str] = Counter()
        toxic: Counter[str] = Counter()
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = {c for word in set(tokens(text)) for c in classes(word)}
            total.update(found)
            if label:
                toxic.update(found)
        yield pa.RecordBatch.from_pydict(
            {"class": list(total), "documents": list(total.values()), "toxic": [toxic[c] for c in total]},
            schema=pa.schema([("class", pa.string()), ("documents", pa.int64()), ("toxic", pa.int64())]),
        )


def surprise(documents: Column, toxic: Column, base: float) -> Column:
    """Minus the logarithm of the chance of so many toxic documents, or so few, at the overall rate (Chernoff's bound of the
    binomial tail, exact where all documents are toxic)."""
    def part(count: Column, rate: float) -> Column:
        return F.when(count > 0, count * F.log(count / (documents * rate))).otherwise(F.lit(0.0))

    return part(toxic, base) + part(documents - toxic, 1 - base)


def _smoothed(counts: dict[str, tuple[int, int]], base: float) -> dict[str, float]:
    """Toxic rate of every class, with the class above as the prior's mean."""
    rates: dict[str, float] = {}
    for name in sorted(counts, key=lambda c: (not c.endswith("*"), len(c))):
        word = name.removesuffix("*")
        above = [word[:n] + "*" for n in STEMS if n < len(word)]
        mean = next((rates[c] for c in reversed(above) if c in rates), base)
        documents, toxic = counts[name]
        rates[name] = (toxic + PRIOR * mean) / (documents + PRIOR)
    return rates


def _decay(histogram: Counter[float]) -> float:
    """The positive root of E[exp(lambda s)] = 1 by bisection."""
    values = np.array(list(histogram))
    weights = np.array([histogram[v] for v in values], dtype=float)
    weights /= weights.sum()

    def excess(decay: float) -> float:
        return float(np.dot(weights, np.exp(np.minimum(decay * values, 500)))) - 1

    low, high = 1e-6, 1.0
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return high


def _score_batches(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            rows: list[tuple[int, int, float, float, str]] = []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                scores = scorer.token_scores(tokens(text))
                found = segments(scores)
                best = max((s for s, _, _ in found), default=0.0)
                # Clean documents give the distribution of token scores: the positive ones, and how many are not.
                positive = "" if label else " ".join(f"{s:.2f}" for s in scores[scores > 0])
                rows.append((label, len(scores), best, float(scores[scores <= 0].sum()), positive))
                rows[-1] = (*rows[-1][:4], positive + "|" + " ".join(f"{s:.4f}" for s, _, _ in found))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            names = (("label", pa.int32()), ("n", pa.int64()), ("best", pa.float64()), ("low", pa.float64()), ("detail", pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(columns, names, strict=True)],
                                             schema=pa.schema(names))

    return run


def _logistic(values: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a logistic curve with a weak normal prior, by Newton's method."""
    design = np.column_stack([np.ones_like(values), values])
    weights = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        gradient = design.T @ (p - labels) + 0.01 * weights
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(weights[0]), float(weights[1])


def learn(documents: DataFrame, labels: DataFrame, learn_from: Column) -> Model:
    """Fits the model on a bounded sample of labelled documents.

    What comes to the driver is bounded by the parameters above: at most ``MODEL_CLASSES`` class counts and one
    short row per learning document. Without labels of both kinds every document gets the share of toxic labels.
    """
    sample = learning_sample(documents, labels, learn_from)
    n, n_toxic = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    base = (n_toxic + 0.5) / (n + 1) if n else 0.0
    empty = Model({}, -DRIFT, 1.0, 1.0, -40.0 if not n else math.log(base / (1 - base)), 0.0)
    if not 0 < n_toxic < n:
        return empty
    tested = stored(
        map_arrow(sample, _count_batches, "class string, documents long, toxic long")
        .groupBy("class").agg(F.sum("documents").alias("documents"), F.sum("toxic").alias("toxic"))
        .filter(F.col("documents") >= MIN_DOCUMENTS),
        "toxicity-classes",
    )
    chance = min(MAX_CHANCE, CHANCE_CLASSES / max(1, tested.count()))
    unlikely = surprise(F.col("documents"), F.col("toxic"), base)
    rows = (
        tested.filter(unlikely >= -math.log(chance)).orderBy(unlikely.desc(), "class").limit(MODEL_CLASSES).collect()
    )
    rates = _smoothed({r["class"]: (r["documents"], r["toxic"]) for r in rows}, base)
    offset = math.log(base / (1 - base))
    scores = {c: round(math.log(r / (1 - r)) - offset - DRIFT, 2) for c, r in rates.items()}
    model = empty._replace(scores=scores)
    scored = map_arrow(sample, _score_batches(model), "label int, n long, best double, low double, detail string").collect()
    histogram: Counter[float] = Counter()
    lengths = exceeding = 0
    for row in scored:
        if not row["label"]:
            positive = [float(s) for s in row["detail"].split("|")[0].split()]
            histogram.update(positive)
            histogram[-DRIFT] += row["n"] - len(positive)
            lengths += row["n"]
    # The prior of the null model: one more token with the score of each strong class.
    for score in {s for s in scores.values() if s > 0}:
        histogram[score] += 0.05
    histogram[-DRIFT] += 1
    decay = _decay(histogram)
    level = max(1.0, 3.0 / decay)
    exceeding = sum(1 for row in scored if not row["label"] and row["best"] >= level)
    scale = (exceeding + 0.5) / max(1.0, lengths * math.exp(-decay * level))
    found = [
        math.log1p(evidence([(float(s), 0, 0) for s in row["detail"].split("|")[1].split()], row["n"], decay, scale))
        for row in scored
    ]
    intercept, slope = _logistic(np.array(found), np.array([float(row["label"]) for row in scored]))
    return model._replace(decay=decay, scale=scale, intercept=intercept, slope=max(0.0, slope))


def toxicity(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, evidence and passages (score, first and end token) of every row.

    Null, empty and letterless texts have no evidence and get the curve's value there; texts may have any length;
    equal texts score alike; other columns are not read; without rows the result is empty.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        passage = pa.struct([("score", pa.float64()), ("start", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            results = [scorer.assess(text.as_py()) for text in batch.column(1)]
            scores = [probability(value, scorer.model) for value, _ in results]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(scores, pa.float64()),
                    pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                    pa.array([value for value, _ in results], pa.float64()),
                    pa.array([[{"score": s, "start": a, "end": b} for s, a, b in found] for _, found in results], pa.list_(passage)),
                ],
                names=["doc_id", "score", "predicted", "evidence", "passages"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_arrow(
        documents.select("doc_id", "text"), run,
        f"doc_id {kind}, score double, predicted int, evidence double, "
        "passages array<struct<score: double, start: int, end: int>>",
    )


def without_toxic(documents: DataFrame, model: Model) -> DataFrame:
    """The rows of ``documents`` that are not predicted toxic, all columns as they are."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            keep = [probability(scorer.assess(text.as_py())[0], scorer.model) < 0.5 for text in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_arrow(documents, run, documents.schema)
