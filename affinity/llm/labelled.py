"""Labelled samples, held-out rows and a logistic fit, shared by the two classifiers.

A classifier is fitted on a bounded sample of labelled rows: at most ``per_class`` of each label, those
with the smallest hash of their id. The bound keeps the fit on the driver small at any corpus size;
class totals, and with them the prior, are counted over all labelled rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text leaves 0 by five; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, y) of the sample, and the number of usable labelled rows of each class.

    Ids with several label rows take the largest label; null ids, null labels and labels other than 0
    and 1 are left out.
    """
    usable = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    counts = {r[0]: r[1] for r in usable.groupBy("y").count().collect()}
    parts = [
        usable.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)
    ]
    chosen = parts[0].unionByName(parts[1])  # at most 2 * per_class ids, whatever the corpus
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return sample, {y: counts.get(y, 0) for y in (0, 1)}


def class_weights(y: np.ndarray, counts: dict[int, int]) -> np.ndarray:
    """Weights that give each class its share of all labelled rows; they sum to the number of sampled rows."""
    total = max(1, sum(counts.values()))
    share = np.array([counts[0], counts[1]]) / total
    own = np.array([max(1, int((y == 0).sum())), max(1, int((y == 1).sum()))])
    return (share / own)[y] * len(y)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Newton steps for a few dense columns; the last coefficient is the intercept (not penalised)."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (weight * (p - y)) + penalty * beta
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        beta -= step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def prior(counts: dict[int, int]) -> float:
    """Smoothed share of label 1 among all labelled rows; a half when there are none."""
    return (counts[1] + 0.5) / (counts[0] + counts[1] + 1)
