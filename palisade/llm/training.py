"""Bounded labelled samples for the classifiers, and logistic regression on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, text_of


def labelled_sample(df: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, y) of at most ``most`` labelled ids outside the held-out fold: those with the least hashes, whatever the partitioning.

    The ids and labels of the sample are at most ``most`` narrow rows, so they are broadcast and no text is shuffled. Of several labels of
    one id the largest counts.
    """
    known = labels.where(labels[label].isNotNull() & (fold_of(labels[id_col], folds) != held_out)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64(F.lit(5), "_id"), "_id").limit(most)
    docs = df.select(df[id_col].alias("id"), text_of(df, text_col).alias("text"))
    return docs.join(F.broadcast(known), docs["id"] == known["_id"]).select("id", "text", "y")


def fit_logistic(x, y, l2: float = 1.0, steps: int = 40):
    """Weights, the intercept last, by Newton's method with a ridge."""
    import numpy as np

    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], l2)
    ridge[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w
