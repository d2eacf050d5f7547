"""Quality classifier by positive-unlabelled learning.

Only trusted positives and unlabelled texts are used, never negatives. A text's features are relative counts of its
characters' shapes (pairs of classes such as upper case, lower case, digit, each mark) and measures of its words and
lines. A first model tells positives from unlabelled texts; on rows it did not see, the least ratio of unlabelled to
positive rows above a threshold of its score, taken at an upper confidence bound, estimates the class prior. The
second model minimises the non-negative unbiased risk with the logistic loss: prior x positives' loss as positive, plus
unlabelled rows' loss as negative less prior x positives' loss as negative, that difference held at 0 or more; where it
falls below, the step goes against it. The score is the model's probability of the positive class.

Models are fitted on bounded samples, `fit_rows` positives and as many unlabelled rows, by a hash of the id. Null and
empty texts have features of 0 and a score like others; null ids take no part in learning. With fewer than four
positives or four drawn unlabelled rows there is nothing to hold out for the prior, and every score is 0.5. Texts are taken whole, however long. Repeated rows and empty tables give as many rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_steps
from .language_id import fit_share

#: Classes of bytes: lower case, upper case, digit, bytes of other characters, space, line feed, full stop, comma, and marks by their code.
_SHAPES = 24
_SHAPE = np.array([0 if 97 <= b < 123 else 1 if 65 <= b < 91 else 2 if 48 <= b < 58 else 3 if b > 127 else {32: 4, 10: 5, 46: 6, 44: 7}.get(b, 8 + b % 16) for b in range(256)], dtype=np.int64)
WIDTH = _SHAPES * _SHAPES + _SHAPES + 9


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray
    prior: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((rows - self.mean) / self.scale @ self.weights + self.bias, -30, 30)))


def features(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), WIDTH), dtype=np.float32)
    pairs = _SHAPES * _SHAPES
    for row, text in zip(out, texts):
        if not text:
            continue
        shape = _SHAPE[np.frombuffer(text.encode(), dtype=np.uint8)]
        row[:pairs] = np.sqrt(np.bincount(shape[:-1] * _SHAPES + shape[1:], minlength=pairs) / max(1, len(shape) - 1))
        row[pairs : pairs + _SHAPES] = np.sqrt(np.bincount(shape, minlength=_SHAPES) / len(shape))
        words, lines = text.split(), text.split("\n")
        n = max(1, len(words))
        row[pairs + _SHAPES :] = (
            np.log1p(len(words)) / 10,
            len(text) / n / 10,
            1 - len(set(lines)) / len(lines),
            len(set(words)) / n,
            len(lines) / n,
            sum(map(str.isupper, words)) / n,
            sum(map(str.isalpha, words)) / n,
            sum(map(str.islower, words)) / n,
            sum(map(eq, words, words[1:])) / n,
        )
    return out


def _descend(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, rounds: int, rate: float = 0.03, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias; without a prior plain logistic regression of positive against unlabelled rows."""
    rows = np.vstack([positive, unlabelled])
    n, m = len(positive), len(unlabelled)
    w, b = np.zeros(rows.shape[1], dtype=np.float32), 0.0
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for k in range(1, rounds + 1):
        z = np.clip(rows @ w + b, -30, 30)
        p = 1 / (1 + np.exp(-z))
        as_positive, as_negative = p - 1, p  # slopes of the two losses
        slope = np.zeros(n + m, dtype=np.float32)
        if prior is None:
            slope[:n], slope[n:] = as_positive[:n] / (2 * n), as_negative[n:] / (2 * m)
        else:
            loss = np.logaddexp(0, z)
            negative_risk = loss[n:].mean() - prior * loss[:n].mean()
            if negative_risk >= 0:
                slope[:n], slope[n:] = prior * (as_positive - as_negative)[:n] / n, as_negative[n:] / m
            else:
                slope[:n], slope[n:] = prior * as_negative[:n] / n, -as_negative[n:] / m
        step = np.append(rows.T @ slope + decay * w, slope.sum())
        first, second = 0.9 * first + 0.1 * step, 0.999 * second + 0.001 * step**2
        move = rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
        w, b = (w - move[:-1]).astype(np.float32), b - float(move[-1])
    return w, b


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled rows, from scores of both."""
    cuts = np.unique(np.concatenate([positive, unlabelled]))[::-1]
    above_p = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    above_u = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    slack = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    keep = above_p > 0
    bound = (above_u[keep] + slack) / above_p[keep]
    best = int(np.argmin(bound))
    return float(np.clip(above_u[keep][best] / above_p[keep][best], 0.05, 0.99))


def fit(docs: DataFrame, positives: DataFrame, is_train: Column, fit_rows: int = 8_000, rounds: int = 400, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """positives: one column of trusted ids. is_train: over docs' columns; rows that may be learnt from."""
    trusted = positives.select(F.col(positives.columns[0]).alias("__id")).dropna().distinct()
    total, n = docs.count(), trusted.count()
    # At most about fit_rows ids: small enough to broadcast.
    trusted = trusted.filter(fit_share(F.col("__id"), fit_rows, n)).withColumn("__trusted", F.lit(True))
    rows = docs.select(F.col(text_column).alias("text"), F.col(id_column).alias("id"), is_train.alias("train")).filter(F.col("train") & F.col("id").isNotNull())
    rows = rows.join(F.broadcast(trusted), F.col("id") == F.col("__id"), "left")
    trust = F.coalesce(F.col("__trusted"), F.lit(False))
    rows = rows.select("text", trust.alias("trusted"), fit_share(F.concat(F.lit("u/"), "id"), fit_rows, total).alias("drawn")).filter("trusted or drawn")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_steps(batches):
            raw = features(texts)
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array([x.tobytes() for x in raw], pa.binary())], names=["trusted", "drawn", "x"])

    found = rows.mapInArrow(measure, "trusted boolean, drawn boolean, x binary").toPandas()
    x = np.frombuffer(b"".join(found["x"]), dtype=np.float32).reshape(-1, WIDTH)
    order = np.lexsort(x[:, -_SHAPES - 9 :].T)  # rows come in any order
    x, is_trusted, is_drawn = x[order], found["trusted"].to_numpy(dtype=bool)[order], found["drawn"].to_numpy(dtype=bool)[order]
    positive, unlabelled = x[is_trusted], x[is_drawn]
    if min(len(positive), len(unlabelled)) < 4:
        return Model(np.zeros(WIDTH, dtype=np.float32), 0.0, np.zeros(WIDTH, dtype=np.float32), np.ones(WIDTH, dtype=np.float32), 0.5)
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 0.01
    positive, unlabelled = (positive - mean) / scale, (unlabelled - mean) / scale
    w, b = _descend(positive[::2], unlabelled[::2], None, rounds // 2)
    prior = estimate_prior(positive[1::2] @ w + b, unlabelled[1::2] @ w + b)
    w, b = _descend(positive, unlabelled, prior, rounds)
    return Model(w, b, mean, scale, prior)


def predict(docs: DataFrame, model: Model, threshold: float = 0.3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score, predicted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_steps(batches):
            score = model.score(features(texts)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[id_column, "score", "predicted"])

    kind = dict(docs.dtypes)[id_column]
    return docs.select(text_column, id_column).mapInArrow(run, f"`{id_column}` {kind}, score double, predicted int")


def keep(docs: DataFrame, model: Model, threshold: float = 0.3, text_column: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose texts score at least the threshold."""
    columns = [text_column, *(c for c in docs.columns if c != text_column)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_steps(batches):
            yield part.filter(pa.array(model.score(features(texts)) >= threshold))

    ordered = docs.select(*columns)
    return ordered.mapInArrow(run, ordered.schema).select(*docs.columns)
