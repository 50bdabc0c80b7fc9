"""Labelled rows to learn from: a bounded sample, chosen by a hash of the id, and a small logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    """True for the rows that nothing may be learned from: crc32 of the id as text, modulo folds, is fold. A null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % folds == fold


def sampled(rows: DataFrame, limit: int, *key: str) -> DataFrame:
    """At most limit rows, those whose key has the least hashes. Of many rows most are turned away where they are read, so that partitions send few to be compared."""
    total, order = rows.count(), F.xxhash64(*key)
    if total > 4 * limit:
        rows = rows.where(F.pmod(order, F.lit(total // (2 * limit))) == 0)
    return rows.orderBy(order).limit(limit)


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, limit: int) -> DataFrame:
    """(text, label) of at most limit labelled documents, with repeated texts once. Labels of held-out rows, null labels and null ids are left out; of differing labels for an id the larger holds.

    The ids are chosen by their hash, limit of them at most, so their broadcast is bounded whatever the size of labels.
    """
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
    ids = sampled(ids.groupBy("doc_id").agg(F.max(label).cast("int").alias("_label")), limit, "doc_id")
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(ids), "doc_id").select("text", F.col("_label").alias("label"))
    return found.groupBy("text").agg(F.max("label").alias("label"))


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Weights (the last one the constant) by Newton's method. Without both classes only the constant speaks, smoothed by half a row of each."""
    x = np.column_stack([x, np.ones(len(y))])
    w = np.zeros(x.shape[1])
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    if not 0 < y.sum() < len(y):
        return w
    penalty = np.full(len(w), ridge)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ w, -30, 30)))
