"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

*Features.* Each distinct lower-cased word of a text sets one of ``DIM`` hashed slots (xxh64), with value
``1 / sqrt(distinct words)`` so that long and short texts weigh alike. Dense slots follow: structure statistics of
the whole text (length, word and line shapes, letters, capitals, digits, punctuation, symbols, repeated lines and
words, line ends) and the metadata ``n_chars`` (its logarithm, and a flag for null). Dense values are centred and
scaled by the learning sample. Labels, language, source and id are never features.

*Model.* ``y = w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j`` with ``FACTORS`` factors per slot. The pairwise
part is scored in linear time by the sum-of-squares identity
``sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``; the score is the logistic of y.

*Learning.* About ``LEARNING_DOCUMENTS`` labelled documents (chosen by a digest of the id, one text per id; repeated
labels of an id count as good if any is) are turned into features on the executors and fitted in one executor task
by Adam on the logistic loss with L2 decay, in a fixed order, so reruns agree; only the model reaches the driver. Scoring reads every whole text, one Arrow
batch at a time, with the model broadcast (``DIM * (FACTORS + 1)`` floats, 9.4 MB).

Odd input: null and empty texts have only their dense features and get a defined score; ids of any type pass
through; repeated rows score alike; extra columns are not read; an empty table gives no rows, and with no usable
labels the model is the prior (every score the same).
"""

from __future__ import annotations

import io
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.llm.common import map_arrow, share, stored

# Parameters of the model: hashed word slots, factors, and the bound on the labelled documents it is fitted on.
DIM = 1 << 18
FACTORS = 8
LEARNING_DOCUMENTS = 20_000
EPOCHS = 12
BATCH = 256
RATE = 0.02
DECAY = 1e-5
THRESHOLD = 0.3

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_GAPS = re.compile(r"[\x20\x09-\x0D]+")
_LETTERS = regex.compile(r"\p{L}+")
_UPPER = regex.compile(r"\p{Lu}+")
_DIGITS = regex.compile(r"\p{Nd}+")
_SPACES = regex.compile(r"\s+")
_LONG_WORD = re.compile(r"[^\x20\x09-\x0D]{13,}")
_CAPITAL_WORD = regex.compile(r"(?<![^\x20\x09-\x0D])\p{Lu}")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_PUNCT = re.compile(r"[.,;:!?\"'()\[\]{}-]")
DENSE = (
    "log_words", "mean_word", "long_words", "letters", "capitals", "digits", "punctuation", "symbols", "blank_share",
    "log_lines", "short_lines", "repeated_lines", "line_ends", "unique_words", "first_capital", "log_n_chars", "null_n_chars",
)


class Model(NamedTuple):
    bias: float
    linear: np.ndarray  # DIM + len(DENSE)
    factors: np.ndarray  # (DIM + len(DENSE), FACTORS)
    centre: np.ndarray  # len(DENSE)
    spread: np.ndarray  # len(DENSE)


def _run_length(pattern: regex.Pattern, text: str) -> int:
    return sum(map(len, pattern.findall(text)))


def _dense(text: str, n_chars: int | None, lowered: list[str] | None = None) -> list[float]:
    """The structure statistics of a whole text; characters are counted by runs, so no Python loop visits each one.

    ``lowered`` are the words of the lower-cased text, if the caller has them already.
    """
    lowered = _WORD.findall(text.lower()) if lowered is None else lowered
    n, size = len(lowered), max(1, len(text))
    lines = [line for line in text.split("\n") if line.strip()]
    word_chars = size - _run_length(_GAPS, text) if text else 0
    letters = _run_length(_LETTERS, text)
    stripped = [line.strip() for line in lines]
    return [
        math.log1p(n),
        word_chars / n if n else 0.0,
        len(_LONG_WORD.findall(text)) / n if n else 0.0,
        letters / size,
        _run_length(_UPPER, text) / max(1, letters),
        _run_length(_DIGITS, text) / size,
        len(_PUNCT.findall(text)) / size,
        len(_SYMBOL.findall(text)) / size,
        _run_length(_SPACES, text) / size,
        math.log1p(len(lines)),
        sum(len(line.split()) < 4 for line in lines) / len(lines) if lines else 0.0,
        1.0 - len(set(stripped)) / len(stripped) if stripped else 0.0,
        sum(line[-1] in ".!?\"'" for line in stripped) / len(stripped) if stripped else 0.0,
        len(set(lowered)) / n if n else 0.0,
        len(_CAPITAL_WORD.findall(text)) / n if n else 0.0,
        math.log1p(n_chars) if n_chars is not None and n_chars >= 0 else 0.0,
        1.0 if n_chars is None else 0.0,
    ]


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed word slots with their values, and the raw dense values, of one whole text."""
    text = text or ""
    lowered = _WORD.findall(text.lower())
    distinct = set(lowered)
    slots = np.unique(np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) % DIM for w in distinct),
                                  np.int64, len(distinct)))
    values = np.full(len(slots), 1.0 / math.sqrt(max(1, len(distinct))), np.float32)
    return slots, values, np.asarray(_dense(text, n_chars, lowered), np.float64)


def _full(slots: np.ndarray, values: np.ndarray, dense: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    scaled = (dense - model.centre) / model.spread
    return np.concatenate([slots, DIM + np.arange(len(DENSE))]), np.concatenate([values, scaled]).astype(np.float64)


def raw_score(index: np.ndarray, value: np.ndarray, model: Model) -> float:
    """w0 + linear part + pairwise part by the sum-of-squares identity; linear in the non-zero slots."""
    v = model.factors[index] * value[:, None]
    pairwise = 0.5 * float(np.sum(v.sum(axis=0) ** 2 - (v**2).sum(axis=0)))
    return model.bias + float(model.linear[index] @ value) + pairwise


def probability(y: float) -> float:
    return 1.0 / (1.0 + math.exp(-y)) if y >= 0 else math.exp(y) / (1.0 + math.exp(y))


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t.as_py(), c.as_py()) for t, c in zip(batch.column(1), batch.column(2))]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(3),
                pa.array([f[0] for f in found], pa.list_(pa.int64())),
                pa.array([f[1] for f in found], pa.list_(pa.float32())),
                pa.array([f[2] for f in found], pa.list_(pa.float64())),
            ],
            names=["doc_id", "label", "slots", "values", "dense"],
        )


def learning_sample(documents: DataFrame, labels: DataFrame, learn_from: Column) -> DataFrame:
    """doc_id, text, n_chars and label of about ``LEARNING_DOCUMENTS`` labelled ids that ``learn_from`` admits.

    The choice depends on the ids alone; an id gives one row (its smallest text), so an id repeated a million times
    still brings one row.
    """
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("label")).filter(
        learn_from & F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()
    )
    ids = usable.groupBy("doc_id").agg(F.max("label").alias("label"))
    fraction = min(1.0, LEARNING_DOCUMENTS / max(1, ids.count()))
    chosen = stored(ids.filter(share(F.col("doc_id"), "quality-model") < fraction), "quality-ids")
    texts = documents.select("doc_id", "text", "n_chars").join(chosen, "doc_id").groupBy("doc_id").agg(
        F.min_by(F.struct("text", "n_chars", "label"), F.struct(F.sha2(F.coalesce("text", F.lit("")), 256), "n_chars")).alias("r")
    )
    return texts.select("doc_id", "r.text", F.col("r.n_chars").cast("long").alias("n_chars"), "r.label")


def fit(rows: list, seed: int = 0) -> Model:
    """Adam on the logistic loss over (label, slots, values, dense) rows, in the given order."""
    n_dense = len(DENSE)
    dense = np.array([r[3] for r in rows], np.float64).reshape(len(rows), n_dense)
    centre = dense.mean(axis=0) if len(rows) else np.zeros(n_dense)
    spread = dense.std(axis=0) if len(rows) else np.ones(n_dense)
    spread = np.where(spread > 1e-9, spread, 1.0)
    labels = np.array([r[0] for r in rows], np.float64)
    prior = (labels.sum() + 1.0) / (len(labels) + 2.0)
    width = DIM + n_dense
    chooser = np.random.default_rng(seed)
    params = {"b": np.array([math.log(prior / (1 - prior))]), "w": np.zeros(width), "v": chooser.normal(0, 0.01, (width, FACTORS))}
    moments = {k: (np.zeros_like(p), np.zeros_like(p)) for k, p in params.items()}
    model = Model(params["b"][0], params["w"], params["v"], centre, spread)
    examples = [_full(np.asarray(r[1], np.int64), np.asarray(r[2], np.float32), np.asarray(r[3], np.float64), model)
                for r in rows]
    step = 0
    for _ in range(EPOCHS if rows else 0):
        order = chooser.permutation(len(rows))
        for start in range(0, len(rows), BATCH):
            chosen = order[start : start + BATCH]
            row = np.concatenate([np.full(len(examples[i][0]), k) for k, i in enumerate(chosen)])
            col = np.concatenate([examples[i][0] for i in chosen])
            val = np.concatenate([examples[i][1] for i in chosen])
            w, v = params["w"], params["v"]
            xv = v[col] * val[:, None]
            sums = np.zeros((len(chosen), FACTORS))
            np.add.at(sums, row, xv)
            squares = np.zeros(len(chosen))
            np.add.at(squares, row, (xv**2).sum(axis=1))
            linear = np.zeros(len(chosen))
            np.add.at(linear, row, w[col] * val)
            y = params["b"][0] + linear + 0.5 * ((sums**2).sum(axis=1) - squares)
            g = (1.0 / (1.0 + np.exp(-y)) - labels[chosen]) / len(chosen)
            # Only the slots of the batch move (lazy Adam); their gradients are gathered by local index.
            touched, local = np.unique(col, return_inverse=True)
            grad_w = np.zeros(len(touched))
            np.add.at(grad_w, local, g[row] * val)
            grad_v = np.zeros((len(touched), FACTORS))
            np.add.at(grad_v, local, g[row, None] * (val[:, None] * sums[row] - v[col] * (val**2)[:, None]))
            step += 1
            for key, at, grad in (("b", slice(None), np.array([g.sum()])), ("w", touched, grad_w), ("v", touched, grad_v)):
                p = params[key]
                grad = grad + (DECAY * p[at] if key != "b" else 0.0)
                m, s = moments[key]
                m[at] = 0.9 * m[at] + 0.1 * grad
                s[at] = 0.999 * s[at] + 0.001 * grad**2
                p[at] -= RATE * (m[at] / (1 - 0.9**step)) / (np.sqrt(s[at] / (1 - 0.999**step)) + 1e-8)
    # Slots that no learning text has keep no weight: an unseen word adds nothing, not its random start.
    seen = np.zeros(width, bool)
    for index, _ in examples:
        seen[index] = True
    params["v"][~seen] = 0.0
    return Model(float(params["b"][0]), params["w"].astype(np.float32), params["v"].astype(np.float32), centre, spread)


def _fit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fits the model on all rows that reach this one task (the bounded sample) and gives it as one binary cell."""
    found = []
    for batch in batches:
        found.extend(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False),
                         batch.column(3).to_numpy(zero_copy_only=False), batch.column(4).to_numpy(zero_copy_only=False)))
        del batch
    found.sort(key=lambda r: (str(r[0]), r[1]))
    model = fit([(label, slots, values, dense) for _, label, slots, values, dense in found])
    del found
    out = io.BytesIO()
    np.savez(out, bias=np.array([model.bias]), linear=model.linear, factors=model.factors, centre=model.centre, spread=model.spread)
    yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["model"])


def _loaded(blob: bytes) -> Model:
    held = np.load(io.BytesIO(blob))
    return Model(float(held["bias"][0]), held["linear"], held["factors"], held["centre"], held["spread"])


def learn(documents: DataFrame, labels: DataFrame, learn_from: Column) -> Model:
    """Features of the sample are made in parallel; the sample meets in one task, which fits the model there.

    Only the fitted model (``DIM * (FACTORS + 1)`` floats) comes to the driver, to be broadcast.
    """
    sample = learning_sample(documents, labels, learn_from)
    kind = sample.schema["doc_id"].dataType.simpleString()
    found = map_arrow(
        sample.select("doc_id", "text", "n_chars", "label"), _feature_batches,
        f"doc_id {kind}, label int, slots array<long>, values array<float>, dense array<double>",
    )
    return _loaded(map_arrow(found.repartition(1), _fit_batches, "model binary").first()["model"])


def quality_scores(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (the probability of a good label), predicted (score >= 0.3) and n_slots of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            scores, slots = [], []
            for text, n_chars in zip(batch.column(1), batch.column(2)):
                index, value = _full(*features(text.as_py(), n_chars.as_py()), held)
                scores.append(probability(raw_score(index, value, held)))
                slots.append(len(index) - len(DENSE))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()),
                 pa.array(slots, pa.int64())],
                names=["doc_id", "score", "predicted", "n_slots"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_arrow(
        documents.select("doc_id", "text", F.col("n_chars").cast("long")), run,
        f"doc_id {kind}, score double, predicted int, n_slots long",
    )
