"""Toxicity: a counterfactual-regularised classifier.

Each labelled text that names a group is paired with a copy in which the identity
terms of its sentences are swapped for others of the same kind.  Training adds to
the logistic loss a penalty on the squared change of the score between the two, so
that weight moves off the terms themselves and neutral mentions of a group are not
taken for abuse.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm import textkernel as tk
from logweave.llm.features import FeatureSpec, rows_of
from logweave.llm.labelled import training_sample
from logweave.llm.quality import FTRL, LinearModel, sigmoid

#: Identity terms by kind; terms of one kind stand for each other.
IDENTITY_TERMS: dict[str, tuple[str, ...]] = {
    "gender": ("woman", "women", "man", "men", "girl", "boy", "female", "male", "transgender", "nonbinary", "femme", "homme", "mujer", "hombre", "frau", "mann"),
    "orientation": ("gay", "lesbian", "bisexual", "straight", "queer", "heterosexual", "homosexual"),
    "religion": ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant", "sikh"),
    "origin": ("african", "asian", "european", "american", "mexican", "arab", "chinese", "indian", "latino", "german", "french", "spanish"),
    "colour": ("black", "white", "brown"),
    "ability": ("blind", "deaf", "disabled", "autistic", "paralysed"),
    "age": ("old", "young", "elderly", "teenage"),
}

#: Words and the beginnings of words, so that inflected forms share weight.
PRESENCE = FeatureSpec(bits=18, words=1, shapes=0, presence=True, prefixes=(4, 5, 6))


def swap_identity(text: str, turn: int = 0, terms: dict[str, tuple[str, ...]] = IDENTITY_TERMS) -> str:
    """The text with each identity term replaced by the next of its kind (by ``turn + 1`` places).

    A sentence without such terms, and a text without any, stays as it is.
    """
    place = {t: (kind, i) for kind, ts in terms.items() for i, t in enumerate(ts)}

    def other(m: re.Match) -> str:
        found = place.get(m[0].lower())
        if found is None:
            return m[0]
        ts = terms[found[0]]
        new = ts[(found[1] + 1 + turn % (len(ts) - 1)) % len(ts)]
        return new.capitalize() if m[0][0].isupper() else new

    return re.sub(r"[A-Za-z]+", other, text)


def fit_counterfactual(
    sample: Sequence[tuple[str, int]], spec: FeatureSpec = PRESENCE, penalty: float = 1.0, epochs: int | None = None, alpha: float = 0.5, l1: float | None = None, l2: float = 0.01, terms: dict[str, tuple[str, ...]] = IDENTITY_TERMS
) -> LinearModel:
    """Fit on the sample and its counterfactual copies.

    For a pair with margins z and z' the loss is log-loss(z, y) + penalty * (z - z')**2.
    A class without rows leaves a constant score.  By default there are about 36,000
    updates in 6 to 40 passes, and l1 grows with the root of the sample's size.
    """
    size = 1 << spec.bits
    epochs = epochs or int(min(40, max(6, 36_000 / max(1, len(sample)))))
    l1 = max(1.0, 10.0 * (len(sample) / 6000) ** 0.5) if l1 is None else l1
    ys = np.array([y for _, y in sample], dtype=float)
    n1, n0 = float(ys.sum()), float(len(ys) - ys.sum())
    if not n0 or not n1:
        return LinearModel(spec, np.zeros(size, np.float32), 0.0 if n0 == n1 else (2.0 if n1 else -2.0))
    texts = [t for t, _ in sample]
    swapped = [swap_identity(t, i, terms) for i, t in enumerate(texts)]
    changed = [i for i, (a, b) in enumerate(zip(texts, swapped, strict=True)) if a != b]

    def features(strings: list[str]) -> list[tuple[np.ndarray, np.ndarray | None]]:
        buf, offsets = tk.utf8(pa.array(strings, pa.large_string()))
        out = []
        for idx, val in rows_of(buf, offsets, spec):
            u, back = np.unique(idx, return_inverse=True)
            out.append((u.astype(np.int32), None if spec.presence else np.bincount(back, weights=val, minlength=len(u))))  # of presence all values are 1
        return out

    def values(row: tuple[np.ndarray, np.ndarray | None]) -> np.ndarray:
        return np.ones(len(row[0])) if row[1] is None else row[1]

    rows = features(texts)
    twins = dict(zip(changed, features([swapped[i] for i in changed]), strict=True))
    del texts, swapped
    tk.release()
    model, bias = FTRL(size, alpha=alpha, l1=l1, l2=l2), FTRL(1, alpha=alpha)
    scale = np.where(ys == 1, len(ys) / (2 * n1), len(ys) / (2 * n0))
    zero = np.zeros(1, np.int64)
    for _ in range(epochs):
        for i, (row, y, c) in enumerate(zip(rows, ys, scale, strict=True)):
            twin, idx, val = twins.get(i), row[0], values(row)
            if twin is None:
                u, v, dv = idx, val, None
            else:
                u = np.union1d(idx, twin[0])
                v, v2 = np.zeros(len(u)), np.zeros(len(u))
                v[np.searchsorted(u, idx)] = val
                v2[np.searchsorted(u, twin[0])] = values(twin)
                dv = v - v2
            w, b = model.weights(u), bias.weights()
            g = c * (sigmoid(w @ v + b[0]) - y)
            gradient = g * v
            if dv is not None:
                gradient = gradient + 2.0 * penalty * (w @ dv) * dv
            model.step(u, gradient, w)
            bias.step(zero, np.array([g]), b)
    return LinearModel(spec, model.weights().astype(np.float32), float(bias.weights()[0]))


def train_toxicity(docs: DataFrame, labels: DataFrame, not_in, label: str = "toxic", sample_rows: int = 6000, penalty: float = 1.0) -> LinearModel:
    """A model of ``labels[label]`` fitted on at most ``sample_rows`` labelled texts and their swapped copies."""
    model = fit_counterfactual(training_sample(docs, labels, label, sample_rows, not_in), penalty=penalty)
    tk.release()
    return model


def score_toxicity(docs: DataFrame, model: LinearModel, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of docs with ``score`` (probability of abuse) and ``predicted`` added; columns of those names are replaced.

    Every row is kept, in one pass without a shuffle.  A null or empty text gets the
    model's bias alone; repeated rows score alike; an empty table stays empty.
    """
    scored = docs.withColumn("score", model.score(F.col(text)))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))
