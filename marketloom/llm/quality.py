"""Quality classifier by positive-unlabelled learning (operator 4).

The model sees trusted positives and unlabelled web text; labelled negatives serve nothing. The class prior is estimated from the two: a
classifier of positives against unlabelled text scores the half it hasn't seen, and of all thresholds the share of unlabelled over that of positive
documents above it, where its upper bound is least, is the share of positives among the unlabelled. The model minimises the non-negative unbiased risk: prior * loss(positive) + max(0, loss(unlabelled as negative) - prior * loss(positive as
negative)); where the bracket falls under zero, the step goes the other way, as it would be overfitting. The loss is logistic, so a
score estimates the probability of label 1.

Inputs of a score are shares of character classes and of their pairs over the whole UTF-8 text, its size, and its word and line
statistics; labels, lang, source and doc_id are none.

The fit uses at most `bound` positives and `bound` unlabelled documents, those of the smallest hashes of their ids (a documented
bound, the same at every size); every document is scored.

Defined cases: a null text is empty, and an empty text has a score as any other; null labels, or labels of a null doc_id, are no labels;
labels that disagree on a document count as their smallest; of rows of one doc_id with different texts the one of the smallest features trains; repeated
rows get equal scores; a very long text is one row of a batch and is read whole; with no positive or no unlabelled
training row every score is 0.5; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import slices

#: The character classes, as the bytes that belong to each; a byte of none is in the last class.
CLASSES = [
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".", b",", b"!", b"?", b"'\"`",
    b"()[]{}<>", b"|", b"#$%&*@^~=+_\\/", b";:-", bytes(range(128, 256)),
]
N = len(CLASSES) + 1
CLASS_OF = np.full(256, N - 1, np.uint8)
for _k, _c in enumerate(CLASSES):
    CLASS_OF[list(_c)] = _k
WIDTH = N + N * N + 9

#: A document is held out of training where this remainder of its hash is this one.
FOLDS, HELD_OUT = 4, 2


def features(text: str) -> np.ndarray:
    """Class shares, shares of class pairs, and nine statistics of size, words and lines; over the whole text."""
    raw = text.encode()
    x = np.zeros(WIDTH)
    if raw:
        c = CLASS_OF[np.frombuffer(raw, np.uint8)]
        pairs = np.bincount(c[:-1].astype(np.uint16) * N + c[1:], minlength=N * N)
        x[:N] = np.bincount(c, minlength=N) / len(c)
        x[N : N + N * N] = pairs / max(1, len(c) - 1)
    words, lines = text.split(), text.split("\n")
    n, m = len(words), len(lines)
    distinct = len(set(words))
    x[-9:] = (
        np.log1p(len(raw)), np.log1p(n), len(text) / (n + 1) / 10, distinct / (n + 1), np.log1p(n - distinct),
        np.log1p(m), np.log1p(len(text) / m), len(set(lines)) / m, sum(map(eq, words, words[1:])) / (n + 1),
    )
    return x


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def slopes(p: np.ndarray, u: np.ndarray, prior: float, w: np.ndarray, b: float) -> np.ndarray:
    """Of the non-negative risk by weights and bias; where its bracket is negative, of the bracket the other way."""
    sp, su = sigmoid(p @ w + b), sigmoid(u @ w + b)
    # The logistic loss of z as a positive is log(1 + e^-z), as a negative log(1 + e^z); their slopes are s - 1 and s.
    bracket = -np.log(1 - su + 1e-12).mean() + prior * np.log(1 - sp + 1e-12).mean()
    slope = lambda dp, du: np.append(p.T @ dp / len(p) + u.T @ du / len(u), dp.mean() + du.mean())
    return slope(prior * (sp - 1) - prior * sp, su) if bracket >= 0 else -slope(-prior * sp, su)


def plain_slopes(p: np.ndarray, u: np.ndarray, prior: float, w: np.ndarray, b: float) -> np.ndarray:
    """Of the mean logistic loss of positives against unlabelled rows, both sides weighing the same."""
    dp, du = (sigmoid(p @ w + b) - 1) / 2, sigmoid(u @ w + b) / 2
    return np.append(p.T @ dp / len(p) + u.T @ du / len(u), dp.mean() + du.mean())


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 600, rate: float = 0.02, decay: float = 1e-4, by=slopes) -> Model:
    """The least risk by Adam over all rows at once; deterministic."""
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-4
    p, u = (np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled))
    w, b = np.zeros(both.shape[1]), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, rounds + 1):
        g = by(p, u, prior, w, b)
        g[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model(mean, scale, w, b)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, rounds: int = 150, delta: float = 0.1) -> float:
    """The share of positives among unlabelled rows, from these two alone."""
    if min(len(positive), len(unlabelled)) < 2:
        return 0.5
    scores = [[], []]
    for half in (0, 1):
        model = fit(positive[half::2], unlabelled[half::2], 0.5, rounds, by=plain_slopes)
        for found, rows in zip(scores, (positive, unlabelled), strict=True):
            found.append(model.score(rows[1 - half :: 2]))
    p, u = (np.sort(np.concatenate(x)) for x in scores)
    above = lambda x, at: 1 - np.searchsorted(x, at) / len(x)
    qp, qu = above(p, p), above(u, p)
    slack = sum(np.sqrt(np.log(4 / delta) / (2 * len(x))) for x in (p, u))
    at = (qu / qp + slack / qp).argmin()
    return float(min(0.98, max(0.02, qu[at] / qp[at])))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        made = [features(t or "").astype("<f4").tobytes() for t in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array(made, pa.binary())], ["row", "features"])


def _scored(batches: Iterator[pa.RecordBatch], model: Model | None, prior: float) -> Iterator[pa.RecordBatch]:
    """The last column is the text; a score column takes its place at the end, the text stays."""
    for batch in slices(batches):
        texts = batch.column(batch.num_columns - 1).to_pylist()
        if model is None:
            score = np.full(len(texts), prior)
        else:
            score = model.score(np.array([features(t or "") for t in texts]).astype("<f4").astype(float).reshape(len(texts), WIDTH))
        yield pa.record_batch([*batch.columns[:-1], pa.array(score, pa.float64())], [*batch.schema.names[:-1], "score"])


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, bound: int = 6000) -> tuple[Model | None, float]:
    """docs: doc_id, text; labels: doc_id, quality. The model and the class prior, from documents that are not held out."""
    known = (
        labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out()).select("doc_id", "quality")
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
    )
    draw = F.xxhash64(F.col("doc_id"), F.lit("draw"))
    positive = known.where("quality = 1").select("doc_id", F.lit(True).alias("positive")).orderBy(draw, "doc_id").limit(bound)
    pool = docs.where("doc_id IS NOT NULL").where(~held_out()).select("doc_id").distinct()
    unlabelled = pool.orderBy(F.xxhash64(F.col("doc_id"), F.lit("unlabelled")), "doc_id").limit(bound).select("doc_id", F.lit(False).alias("positive"))
    # Both lists are cut to `bound` ids above, which is the size bound of this broadcast.
    chosen = docs.select("doc_id", "text").join(F.broadcast(positive.unionByName(unlabelled)), "doc_id")
    chosen = chosen.select(F.struct("doc_id", "positive").alias("row"), "text").mapInArrow(_features, f"row struct<doc_id: {docs.schema['doc_id'].dataType.simpleString()}, positive: boolean>, features binary")
    rows = chosen.groupBy("row").agg(F.min("features").alias("features")).orderBy(F.xxhash64("row.doc_id"), "row.doc_id", "row.positive").collect()
    got = {k: np.array([np.frombuffer(r.features, "<f4") for r in rows if r.row.positive is k], dtype=float) for k in (True, False)}
    if not len(got[True]) or not len(got[False]):
        return None, 0.5
    prior = estimated_prior(got[True], got[False])
    return fit(got[True], got[False], prior), prior


def score(docs: DataFrame, model: tuple[Model | None, float], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """row (the columns of keep, in a struct, so that no names clash), and the score of each row's text."""
    fitted, prior = model
    out = docs.select(F.struct(*keep).alias("row"), "text")
    schema = out.select("row", F.lit(0.0).alias("score")).schema
    return out.mapInArrow(lambda it: _scored(it, fitted, prior), schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, bound: int = 6000) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = score(docs, train(docs, labels, bound))
    return out.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, bound: int = 6000) -> DataFrame:
    """The documents that the classifier accepts, with the columns of docs."""
    out = score(docs, train(docs, labels, bound), tuple(docs.columns))
    return out.where(F.col("score") >= threshold).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
