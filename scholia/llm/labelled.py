"""A bounded sample of labelled rows to learn from, and logistic regression on it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.scale import cut

#: Rows of each class to learn from.
PER_CLASS = 6_000
_GRAINS = 1 << 20


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids are in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)), F.lit(0))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text",
                    per_class: int = PER_CLASS) -> tuple[DataFrame, dict[int, int]]:
    """(text, label) of about ``per_class`` rows of each class, and the size of each class.

    The sample is drawn by a hash of the id, so it is bounded however many labels there
    are, and small enough to be broadcast to the documents. Rows without an id, text or
    label and ids with two labels are left out; a text counts once.
    """
    one = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label).alias("label"), F.max(label).alias("most"))
    one = one.where("label = most and label in (0, 1)").select("id", F.col("label").cast("int").alias("label"))
    sizes = {r.label: r.n for r in one.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0)
    for value, n in sizes.items():
        share = F.when(F.col("label") == value, F.lit(int(min(1.0, per_class / n) * _GRAINS))).otherwise(share)
    drawn = one.where(F.pmod(F.xxhash64("id"), F.lit(_GRAINS)) < share)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    found = texts.join(F.broadcast(drawn), "id").select("text", "label").withColumn("key", F.xxhash64("text"))
    return cut(found.dropDuplicates(["key"]).drop("key")), sizes


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Weights that minimise the weighted logistic loss (Newton steps, ridge)."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + l2 * w
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w
