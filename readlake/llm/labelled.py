"""Held-out folds, bounded samples of labelled documents and a one-variable logistic link."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def label_sample(labels: DataFrame, label: str, folds: int, held_out: int, per_class: dict[int, int]) -> DataFrame:
    """(doc_id, label) of training rows, at most ``per_class[value]`` of each value, chosen by a hash of the id.

    Rows of the held-out fold, null ids and null labels take no part; an id with labels of both values counts as the larger.
    The result's size is bounded by ``per_class``.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    parts = [known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for value, most in per_class.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def logistic(x: np.ndarray, y: np.ndarray, prior: float, steps: int = 300) -> tuple[float, float]:
    """Slope and intercept of P(y=1 | x) by damped Newton steps with a weak ridge, moved to the base rate ``prior``."""
    if not len(x) or y.min() == y.max():
        return 0.0, float(np.log(prior / (1 - prior)))
    scale, mean = x.std() or 1.0, x.mean()
    design = np.stack([(x - mean) / scale, np.ones(len(x))])
    w, ridge = np.zeros(2), 1e-2 * len(x)
    for _ in range(min(steps, 50)):
        p = 1 / (1 + np.exp(-np.clip(w @ design, -30, 30)))
        step = np.linalg.solve(design * (p * (1 - p)) @ design.T + np.diag([ridge * 1e-2, 1e-6]), design @ (p - y) + [ridge * 1e-2 * w[0], 0])
        w -= np.clip(step, -2, 2)
        if abs(step).max() < 1e-6:
            break
    own = y.mean()
    shift = np.log(prior / (1 - prior)) - np.log(own / (1 - own))
    return float(w[0] / scale), float(w[1] - w[0] * mean / scale + shift)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
