"""Many binary logistic regressions at once: one gradient of a label matrix per pass over the rows.

Every task adds up the gradients of its rows for all labels; the sums meet by
blocks of features (each block in a task of its own), and only the finished gradient, features
x labels numbers, reaches the driver, which takes L-BFGS steps.  So the number of
passes does not depend on the number of labels.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

#: Features in one block of the gradient.
BLOCK = 4_096


def _margins(weights: np.ndarray, batch):
    """Row numbers, feature numbers, values, margins and labels of an Arrow batch."""
    at, value, label = (batch.column(c) for c in ("at", "value", "label"))
    sizes = np.diff(np.asarray(at.offsets))
    rows, cols, x = np.repeat(np.arange(len(sizes)), sizes), np.asarray(at.flatten()), np.asarray(value.flatten())
    y = np.asarray(label.flatten()).reshape(len(sizes), -1)
    z = np.stack([np.bincount(rows, x * weights[cols, k], len(sizes)) for k in range(weights.shape[1])], axis=1)
    return rows, cols, x, z + weights[-1], y


def _partials(weights: np.ndarray):
    """(block, sums) of the gradient, and (-1, loss of each label and rows)."""
    n, labels = weights.shape

    def run(batches):
        gradient, loss, count = np.zeros((n, labels)), np.zeros(labels), 0
        for batch in batches:
            rows, cols, x, z, y = _margins(weights, batch)
            off = 1 / (1 + np.exp(-z)) - y
            for k in range(labels):
                gradient[:, k] += np.bincount(cols, x * off[rows, k], n)
            gradient[-1] += off.sum(axis=0)
            loss += (np.logaddexp(0, z) - y * z).sum(axis=0)
            count += len(y)
        if count:
            blocks = [(b, gradient[b * BLOCK : (b + 1) * BLOCK].tobytes()) for b in range(-(-n // BLOCK)) if gradient[b * BLOCK : (b + 1) * BLOCK].any()]
            blocks.append((-1, np.append(loss, count).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in blocks], pa.int32()), pa.array([s for _, s in blocks], pa.binary())], ["block", "sums"])

    return run


def _added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for s in batch.column("sums").to_pylist():
            part = np.frombuffer(s)
            total = part.copy() if total is None else total + part
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "sums"])


def _loss_and_gradient(rows: DataFrame, weights: np.ndarray, reg: float):
    parts = rows.mapInArrow(_partials(weights), "block int, sums binary").groupBy("block")
    found = {r["block"]: np.frombuffer(bytes(r["sums"])) for r in parts.applyInArrow(_added, "block int, sums binary").collect()}
    count = found[-1][-1]
    gradient = np.zeros_like(weights)
    for b, s in found.items():
        if b >= 0:
            part = s.reshape(-1, weights.shape[1])
            gradient[b * BLOCK : b * BLOCK + len(part)] = part / count
    penalised = weights[:-1]
    gradient[:-1] += reg * penalised
    return found[-1][:-1].sum() / count + reg / 2 * float((penalised**2).sum()), gradient


def sparse_rows(df: DataFrame, features: str) -> DataFrame:
    """Adds ``at`` and ``value``: places and values of the entries of a sparse vector column (``unwrap_udt`` reads its struct)."""
    v = F.unwrap_udt(F.col(features))
    dense = F.sequence(F.lit(0), F.size(v["values"]) - 1)
    return df.withColumn("at", F.when(v["type"] == 0, v["indices"]).otherwise(dense)).withColumn("value", v["values"])


def fit_labels(df: DataFrame, features: str, labels: list[str], size: int, reg: float = 0.01, iterations: int = 30, tolerance: float = 1e-6, memory: int = 8) -> tuple[np.ndarray, int]:
    """Weights (size + 1, labels), the last row the intercepts, and the passes made over ``df``.

    Minimises mean log loss + reg / 2 |w|^2 of every label (intercepts are free).  ``features`` is a
    sparse or dense vector column of ``size`` entries; the labels are 0 or 1.
    """
    rows = checkpoint(sparse_rows(df, features).select("at", "value", F.array(*[F.col(c).cast("double") for c in labels]).alias("label")))
    weights = np.zeros((size + 1, len(labels)))
    if rows.isEmpty():
        return weights, 0
    loss, gradient = _loss_and_gradient(rows, weights, reg)
    passes = 1
    steps: deque = deque(maxlen=memory)
    for _ in range(iterations):
        if np.abs(gradient).max() < tolerance:
            break
        direction, used = gradient.copy(), []
        for s, y in reversed(steps):
            a = (s * direction).sum() / (s * y).sum()
            direction -= a * y
            used.append(a)
        if steps:
            s, y = steps[-1]
            direction *= (s * y).sum() / (y * y).sum()
        for (s, y), a in zip(steps, reversed(used), strict=True):
            direction += s * (a - (y * direction).sum() / (s * y).sum())
        rate, slope = (1.0 if steps else min(1.0, 1 / np.abs(gradient).sum())), (gradient * direction).sum()
        for _ in range(20):
            new = weights - rate * direction
            new_loss, new_gradient = _loss_and_gradient(rows, new, reg)
            passes += 1
            if new_loss <= loss - 1e-4 * rate * slope:
                break
            rate /= 2
        else:
            break
        if ((new - weights) * (new_gradient - gradient)).sum() > 1e-12:
            steps.append((new - weights, new_gradient - gradient))
        weights, loss, gradient = new, new_loss, new_gradient
    return weights, passes


def label_scores(df: DataFrame, features: str, weights: np.ndarray, out: str = "scores") -> DataFrame:
    """Append the probabilities of every label (``array<double>``)."""
    df = sparse_rows(df, features)

    @F.arrow_udf("array<double>")
    def score(at: pa.Array, value: pa.Array) -> pa.Array:
        sizes = pc.list_value_length(at).to_numpy(zero_copy_only=False)
        rows, cols, x = np.repeat(np.arange(len(sizes)), sizes), np.asarray(at.flatten()), np.asarray(value.flatten())
        z = np.stack([np.bincount(rows, x * weights[cols, k], len(sizes)) for k in range(weights.shape[1])], axis=1) + weights[-1]
        ends = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * weights.shape[1])
        return pa.ListArray.from_arrays(ends, pa.array((1 / (1 + np.exp(-z))).ravel()))

    return df.withColumn(out, score("at", "value")).drop("at", "value")
