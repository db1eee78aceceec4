"""The bounded sample of labelled rows that a classifier is fitted on, and small numpy fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from sparksync.session import checkpointed


def fold(id_col: str, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % of


def fit_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label) of at most ``rows`` labelled rows outside fold 0 of 5, the first by a hash of the id.

    Where an id has several labels the largest counts; null labels and ids do
    not take part. The ids are at most ``rows`` and are broadcast, so the
    documents are not shuffled.
    """
    train = labels.filter(F.col(label).isNotNull() & (fold(id_col, 5) != 0)).groupBy(id_col).agg(F.max(label).cast("int").alias("label"))
    picked = train.orderBy(F.xxhash64(id_col), id_col).limit(rows).select(F.col(id_col).alias("_picked"), "label")
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return checkpointed(texts.join(F.broadcast(picked), F.col("_id") == F.col("_picked")).select("text", "label"))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression, bias last, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        curve = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
