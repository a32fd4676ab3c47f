"""Sparse linear models trained by follow-the-regularised-leader with elastic-net penalties.

The rows of a bounded sample are dealt over a fixed number of shards. In each round every shard
goes once over its rows from the common state, row by row, and the shards' states are averaged.
The state's size depends on the classes and bins alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ftrl:
    """Step size, its smoothing, and the two penalties; rounds over the rows and shards of them."""

    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 0.5
    l2: float = 1.0
    rounds: int = 3
    shards: int = 4

    def weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Zero where the gradients so far don't outweigh the first penalty."""
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))


def probabilities(scores: np.ndarray) -> np.ndarray:
    """Softmax over the last axis; one score alone is a logistic's."""
    if scores.shape[-1] == 1:
        return 1 / (1 + np.exp(-np.clip(scores, -35, 35)))
    e = np.exp(scores - scores.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _pass(state, settings: Ftrl, classes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, n = (x.astype(float) for x in state.value)
        rows = 0
        for batch in batches:
            for y, at, values in zip(*(batch.column(c) for c in ("y", "at", "values")), strict=True):
                at, v = at.values.to_numpy(), values.values.to_numpy()
                zi, ni = z[:, at], n[:, at]
                w = settings.weights(zi, ni)
                p = probabilities(w @ v)
                target = np.zeros(classes)
                if classes == 1:
                    target[0] = y.as_py()
                else:
                    target[y.as_py()] = 1
                g = (p - target)[:, None] * v
                g2 = g * g
                z[:, at] = zi + g - (np.sqrt(ni + g2) - np.sqrt(ni)) / settings.alpha * w
                n[:, at] = ni + g2
                rows += 1
        if rows:
            used = np.flatnonzero(n.ravel())
            out = used.astype(np.int32), z.ravel()[used].astype(np.float32), n.ravel()[used].astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in out], names=["used", "z", "n"])

    return run


def train(rows: DataFrame, classes: int, bins: int, settings: Ftrl) -> np.ndarray:
    """Weights (classes, bins) from rows of y (class, or 0 and 1 where classes is 1), at and values.

    Shards are told apart by key, a stable hash of a row; rows of a shard come in its order.
    """
    sc = rows.sparkSession.sparkContext
    z, n = np.zeros((classes, bins)), np.zeros((classes, bins))
    dealt = rows.withColumn("_shard", F.pmod("key", F.lit(settings.shards))).repartition(settings.shards, "_shard").sortWithinPartitions("key").drop("_shard")
    for _ in range(settings.rounds):
        state = sc.broadcast((z.astype(np.float32), n.astype(np.float32)))
        parts = dealt.mapInArrow(_pass(state, settings, classes), "used binary, z binary, n binary").collect()
        state.destroy()
        if not parts:
            break
        total = np.zeros((2, classes * bins))
        for p in parts:
            used = np.frombuffer(p["used"], np.int32)
            total[0, used] += np.frombuffer(p["z"], np.float32)
            total[1, used] += np.frombuffer(p["n"], np.float32)
        z, n = (total / len(parts)).reshape(2, classes, bins)
    return settings.weights(z, n)
