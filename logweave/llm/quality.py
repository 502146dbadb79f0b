"""Quality classifier: hashed word n-gram logistic regression, trained by
follow-the-regularised-leader (FTRL-proximal) updates, scored as sparse dot products.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm import textkernel as tk
from logweave.llm.features import FeatureSpec, dot_rows, rows_of
from logweave.llm.labelled import training_sample


class FTRL:
    """FTRL-proximal for the logistic loss, with per-coordinate learning rates."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.0, l2: float = 0.0):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, idx=slice(None)) -> np.ndarray:
        z = self.z[idx]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[idx])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def step(self, idx: np.ndarray, gradient: np.ndarray, w: np.ndarray) -> None:
        """Apply a gradient at distinct indices, whose weights are w."""
        n = self.n[idx]
        grown = n + gradient * gradient
        self.z[idx] += gradient - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[idx] = grown


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


@dataclass(frozen=True)
class LinearModel:
    """weights: one for each hashed index; the bias is added to every row."""

    spec: FeatureSpec
    weights: np.ndarray = field(repr=False)
    bias: float

    def margins(self, texts: pa.Array) -> np.ndarray:
        buf, offsets = tk.utf8(texts)
        return dot_rows(buf, offsets, self.spec, self.weights) + self.bias

    def score(self, text: Column) -> Column:
        """Probability of label 1 for a text column; null texts count as empty."""
        spec, weights, bias = self.spec, self.weights, self.bias

        @F.arrow_udf("double")
        @tk.trimmed
        def scored(texts: pa.Array) -> pa.Array:
            buf, offsets = tk.utf8(texts)
            return pa.array(sigmoid(dot_rows(buf, offsets, spec, weights) + bias))

        return scored(text)


def fit_ftrl(
    sample: Sequence[tuple[str, int]], spec: FeatureSpec, epochs: int = 4, alpha: float = 0.3, l1: float = 0.02, l2: float = 0.1, prior: float | None = None
) -> LinearModel:
    """Fit by passes over the sample in its order; classes are weighted to equal sums.

    prior: the share of label 1 among all labelled rows, to which the bias is set
    back; None keeps balanced classes.  With no rows of a class the model is its
    prior alone.  The bias is the last coordinate and is not shrunk by l1.
    """
    size = 1 << spec.bits
    ys = np.array([y for _, y in sample], dtype=float)
    n1, n0 = float(ys.sum()), float(len(ys) - ys.sum())
    shift = 0.0 if prior is None else float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    if not n0 or not n1:
        return LinearModel(spec, np.zeros(size, np.float32), shift if n0 == n1 else (2.0 if n1 else -2.0))
    buf, offsets = tk.utf8(pa.array([t for t, _ in sample], pa.large_string()))
    rows = list(rows_of(buf, offsets, spec))
    model, bias = FTRL(size, alpha=alpha, l1=l1, l2=l2), FTRL(1, alpha=alpha)
    scale = np.where(ys == 1, len(ys) / (2 * n1), len(ys) / (2 * n0))
    zero = np.zeros(1, np.int64)
    for _ in range(epochs):
        for (idx, val), y, c in zip(rows, ys, scale, strict=True):
            u, back = np.unique(idx, return_inverse=True)
            v = np.bincount(back, weights=val, minlength=len(u))
            w, b = model.weights(u), bias.weights()
            g = c * (sigmoid(w @ v + b[0]) - y)
            model.step(u, g * v, w)
            bias.step(zero, np.array([g]), b)
    return LinearModel(spec, model.weights().astype(np.float32), float(bias.weights()[0]) + shift)


def train_quality(docs: DataFrame, labels: DataFrame, not_in, label: str = "quality", sample_rows: int = 6000, spec: FeatureSpec | None = None) -> LinearModel:
    """A model of ``labels[label]`` fitted on at most ``sample_rows`` labelled texts.

    not_in: function of an id column, true for rows that may not be learnt from.
    """
    sample = training_sample(docs, labels, label, sample_rows, not_in)
    return fit_ftrl(sample, spec or FeatureSpec())


def score_quality(docs: DataFrame, model: LinearModel, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of docs with ``score`` and ``predicted`` added; columns of those names are replaced.

    Every row is kept, in one pass without a shuffle.  A null or empty text gets the
    model's bias alone; repeated rows score alike; an empty table stays empty.
    """
    scored = docs.withColumn("score", model.score(F.col(text)))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))
