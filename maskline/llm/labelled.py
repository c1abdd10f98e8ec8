"""A bounded sample of labelled documents, for fitting the two classifiers, and their plain parts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, limit: int) -> DataFrame:
    """(text, y) of at most `limit` labelled documents outside the held-out fold, those whose id hashes lowest.

    Rows without an id or a label don't count; of several labels of an id the largest does. The ids
    are at most `limit` numbers, so they are broadcast.
    """
    marks = labels.select("doc_id", F.col(label).alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull())
    marks = marks.where(~held_out(F.col("doc_id"), folds, fold)).groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
    chosen = marks.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.select(F.coalesce("text", F.lit("")).alias("text"), "y")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


class Adam:
    """Steps of gradient descent with adapted rates."""

    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        return w - self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def fit_line(x: np.ndarray, y: np.ndarray, rounds: int = 400) -> tuple[float, float]:
    """(a, b) of the logistic regression of y on one number x."""
    w, adam = np.array([1.0, 0.0]), Adam(2, 0.05)
    for _ in range(rounds):
        d = sigmoid(w[0] * x + w[1]) - y
        w = adam.step(w, np.array([(d * x).mean() + 1e-4 * w[0], d.mean()]))
    return float(w[0]), float(w[1])
