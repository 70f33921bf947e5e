"""Hashed features, follow-the-regularised-leader training on a bounded sample, and scoring as sparse dot products."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataledger.llm.common import ship

#: (indices, values) of a text
Features = tuple[np.ndarray, np.ndarray]


class Hashes(dict):
    """The 64-bit hash of each word, kept for up to a number of words."""

    def __init__(self, most: int = 100_000):
        from xxhash import xxh3_64_intdigest

        self.of, self.most = xxh3_64_intdigest, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        h = self[word] = self.of(word)
        return h


def counted(indices: np.ndarray) -> Features:
    found, n = np.unique(indices, return_counts=True)
    return found.astype(np.uint32), n.astype(np.float32)


@dataclass
class Linear:
    weights: np.ndarray
    bias: float

    def margin(self, x: Features) -> float:
        return float(self.weights[x[0]] @ x[1]) + self.bias

    def score(self, x: Features) -> float:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -30, 30)))


def difference(a: Features, b: Features) -> Features:
    """What tells two sentences apart: the coordinates in which they differ, and by how much."""
    both = np.union1d(a[0], b[0])
    d = np.zeros(len(both))
    d[np.searchsorted(both, a[0])] += a[1]
    d[np.searchsorted(both, b[0])] -= b[1]
    return both[d != 0], d[d != 0]


def train(
    rows: list[Features], labels: list[int], dim: int, pairs: list[tuple[Features, Features] | None] | None = None, invariance: float = 0.0, alpha: float = 0.2, l1: float = 0.3, l2: float = 0.1, epochs: int = 4, seed: int = 0, balanced: bool = True
) -> Linear:
    """Logistic regression by FTRL-proximal updates: per-coordinate rates, weights exactly 0 until |z| exceeds l1.

    balanced lets the rarer class weigh as much as the other. A row's pair is its sentence with two different identity
    terms: every second epoch learns the label from the first of the two instead of the row itself, and invariance times
    half the squared difference of the two margins is added to the loss in every epoch.
    Without rows, or with one class only, the model is a constant: that class, or 0.5.
    """
    y = np.asarray(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return Linear(np.zeros(dim, np.float32), 0.0 if not len(y) else (8.0 if y[0] else -8.0))
    share = y.mean()
    cost = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) if balanced else np.ones(len(y))
    apart = [p and difference(*p) for p in pairs] if pairs and invariance else [None] * len(y)
    z, n = np.zeros(dim), np.zeros(dim)
    bias = bias_n = 0.0
    beta = 1.0

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    def update(i: np.ndarray, w: np.ndarray, g: np.ndarray) -> None:
        sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
        z[i] += g - sigma * w
        n[i] += g * g

    order = np.random.default_rng(seed)
    for epoch in range(epochs):
        for k in order.permutation(len(y)):
            i, v = pairs[k][0] if apart[k] is not None and epoch % 2 else rows[k]
            w = weights(i)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ v + bias, -30, 30)))
            g = cost[k] * (p - y[k])
            bias_n += g * g
            bias -= alpha / (beta + np.sqrt(bias_n)) * g
            update(i, w, g * v)
            if apart[k] is not None:  # only the coordinates in which the two sentences differ move
                both, d = apart[k]
                w = weights(both)
                update(both, w, invariance * float(w @ d) * d)
    return Linear(weights(np.arange(dim)).astype(np.float32), float(bias))


def labelled_sample(labels: DataFrame, label: str, allowed: Column, most: int, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, label) of at most `most` labelled ids, those whose hash comes first; only ids for which allowed holds.

    Null ids and null labels teach nothing; neither does an id with contradictory labels.
    """
    return (
        labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & allowed)
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where("label = other")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
        .select("doc_id", "label")
    )


def collect_examples(docs: DataFrame, sample: DataFrame, featurise: Callable[[str], tuple[Features, Features | None]], doc_id: str, text: str) -> tuple[list[Features], list[Features | None], list[int]]:
    """Features of the sample's documents, made on the executors, and of their twins where they have one.

    Of rows that share an id, the one whose features come first in byte order stands for it; tasks drop the others
    before the shuffle. So the driver gets hashed features of one row an id of the sample, whatever the table holds.
    """

    def pack(x: Features | None) -> tuple[bytes | None, bytes | None]:
        return (None, None) if x is None else (x[0].astype(np.uint32).tobytes(), x[1].astype(np.float32).tobytes())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [featurise(t or "") for t in batch["text"]]
            yield pd.DataFrame(
                [(str(k), int(label), *pack(x), *pack(twin)) for k, label, (x, twin) in zip(batch["doc_id"], batch["label"], made, strict=True)], columns=["doc_id", "label", "i", "v", "ti", "tv"]
            )

    ship(docs.sparkSession)
    chosen = F.broadcast(sample.withColumnRenamed("doc_id", "sample_id"))  # bounded by the sample's size
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(chosen, F.col("doc_id") == F.col("sample_id")).select("doc_id", "label", "text")
    made = rows.mapInPandas(run, "doc_id string, label int, i binary, v binary, ti binary, tv binary")
    found = made.groupBy("doc_id").agg(F.min(F.struct("label", "i", "v", "ti", "tv")).alias("x")).select("doc_id", "x.*").collect()
    found.sort(key=lambda r: r["doc_id"])  # the arrays below are views of these bytes, not copies
    unpack = lambda i, v: None if i is None else (np.frombuffer(i, np.uint32), np.frombuffer(v, np.float32))
    return [unpack(r["i"], r["v"]) for r in found], [unpack(r["ti"], r["tv"]) for r in found], [r["label"] for r in found]


def scored(docs: DataFrame, model: Linear, featurise: Callable[[str], Features], text: str) -> DataFrame:
    """docs packed as (row, score): a sparse dot product a text; the weights are of fixed size, so they are broadcast."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        linear = shared.value
        for texts in batches:
            yield pd.Series([linear.score(featurise(t or "")) for t in texts], dtype="float64")

    return docs.select(F.struct("*").alias("row")).select("row", score(F.col(f"row.`{text}`")).alias("score"))
