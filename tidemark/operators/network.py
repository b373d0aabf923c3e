"""A small multi-layer perceptron in NumPy: trained on the driver from a stream of rows, applied by partition.

Training reads the rows through an iterator, a chunk at a time, so the driver holds one chunk and the weights; early
stopping watches a held share of the chunks.  Prediction is a map over Arrow batches with the weights as a broadcast.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


class Perceptron:
    """Layers of weights with rectifiers between them, and Adam's state; inputs and target are standardised."""

    def __init__(self, inputs: int, hidden: tuple[int, ...] = (64, 32), seed: int = 42, rate: float = 1e-3, decay: float = 0.0):
        rng = np.random.default_rng(seed)
        sizes = [inputs, *hidden, 1]
        self.w = [rng.standard_normal((a, b)) * np.sqrt(2 / a) for a, b in itertools.pairwise(sizes)]
        self.b = [np.zeros(b) for b in sizes[1:]]
        self.state = [[np.zeros_like(x), np.zeros_like(x)] for x in (*self.w, *self.b)]
        self.rate, self.decay, self.step = rate, decay, 0
        self.scale = (np.zeros(inputs), np.ones(inputs), 0.0, 1.0)

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for i, (w, b) in enumerate(zip(self.w, self.b, strict=True)):
            z = out[-1] @ w + b
            out.append(z if i == len(self.w) - 1 else np.maximum(z, 0))
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        mean, sd, low, wide = self.scale
        return self.forward((x - mean) / sd)[-1][:, 0] * wide + low

    def learn(self, x: np.ndarray, y: np.ndarray) -> float:
        """One step on a batch of standardised rows; its mean squared error."""
        layers = self.forward(x)
        error = layers[-1][:, 0] - y
        grad = (2 * error / len(y))[:, None]
        grads: list[np.ndarray] = [None] * (2 * len(self.w))  # type: ignore[list-item]
        for i in range(len(self.w) - 1, -1, -1):
            grads[i] = layers[i].T @ grad + self.decay * self.w[i]
            grads[len(self.w) + i] = grad.sum(axis=0)
            grad = (grad @ self.w[i].T) * (layers[i] > 0)
        self.step += 1
        for p, g, s in zip((*self.w, *self.b), grads, self.state, strict=True):
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.999 * s[1] + 0.001 * g * g
            p -= self.rate * (s[0] / (1 - 0.9**self.step)) / (np.sqrt(s[1] / (1 - 0.999**self.step)) + 1e-8)
        return float((error**2).mean())


def _chunks(df: DataFrame, columns: list[str], rows: int) -> Iterator[np.ndarray]:
    """Rows as arrays of at most `rows`, one partition on the driver at a time."""
    stream = df.select(*[F.col(c).cast("double") for c in columns]).toLocalIterator(prefetchPartitions=False)
    while part := list(itertools.islice(stream, rows)):
        yield np.array(part, float)


def train(df: DataFrame, features: list[str], label: str, epochs: int = 20, batch: int = 256, chunk: int = 50_000, held_each: int = 10, patience: int = 3, **kw) -> Perceptron:
    """Fit by passes over all rows with a label; every `held_each`-th row of a chunk is held to stop early.  Null features count as the mean."""
    df = df.filter(F.col(label).isNotNull())
    s = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in (*features, label)]).first()
    if s[label]["m"] is None:
        raise ValueError("no row has a label")
    mean = np.array([s[c]["m"] or 0.0 for c in (*features, label)])
    sd = np.array([s[c]["s"] or 1.0 for c in (*features, label)])
    net = Perceptron(len(features), **kw)
    net.scale = (mean[:-1], sd[:-1], mean[-1], sd[-1])
    rng, best, kept, waited = np.random.default_rng(kw.get("seed", 42)), np.inf, None, 0
    for _ in range(epochs):
        losses, weights = [], []
        for part in _chunks(df, [*features, label], chunk):
            part = np.nan_to_num((part - mean) / sd)
            held = np.arange(len(part)) % held_each == held_each - 1
            rows = part[~held]
            for at in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // batch)):
                net.learn(rows[at, :-1], rows[at, -1])
            judge = part[held] if held.any() else rows
            losses.append(float(((net.forward(judge[:, :-1])[-1][:, 0] - judge[:, -1]) ** 2).mean()))
            weights.append(len(judge))
        loss = float(np.average(losses, weights=weights))
        if loss < best - 1e-6:
            best, waited, kept = loss, 0, ([w.copy() for w in net.w], [b.copy() for b in net.b])
        else:
            waited += 1
            if waited >= patience:
                break
    if kept:
        net.w, net.b = kept
    return net


def predicted(df: DataFrame, net: Perceptron, features: list[str], name: str = "prediction") -> DataFrame:
    """The rows with a prediction each, batch by batch on the executors."""
    told = df.sparkSession.sparkContext.broadcast(net)  # of the network's size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b[features].to_numpy(float)
            x = np.where(np.isnan(x), told.value.scale[0], x)
            yield b.assign(**{name: told.value.predict(x) if len(b) else np.zeros(0)})

    from pyspark.sql.types import StructType

    return df.mapInPandas(run, StructType(list(df.schema.fields)).add(name, DoubleType()))  # add changes what it is called on
