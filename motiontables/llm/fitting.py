"""Small models fitted on bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Logistic:
    """Ridge logistic regression by Newton steps on standardised features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = np.column_stack([np.clip((x - self.mean) / self.scale, -6, 6), np.ones(len(x))])
        weight = np.ones(len(x)) if weight is None else weight
        penalty = np.append(np.full(x.shape[1], ridge), 1e-6)
        self.beta = np.zeros(z.shape[1])
        for _ in range(25):
            p = sigmoid(z @ self.beta)
            gradient = z.T @ (weight * (y - p)) - penalty * self.beta
            step = np.linalg.solve((z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(penalty), gradient)
            self.beta += step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
            if np.abs(step).max() < 1e-6:
                break

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.beta[:-1] + self.beta[-1]


def labelled_ids(labels: DataFrame, column: str, per_class: int, where: str = "true") -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_class`` ids per class of a 0/1 label, those of lowest hash, and the class sizes.
    A doc_id with several labels counts with its largest; null ids and labels are left out."""
    own = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
           .where(f"doc_id IS NOT NULL AND label IN (0, 1) AND ({where})").groupBy("doc_id").agg(F.max("label").alias("label")))
    sizes = {r["label"]: r["n"] for r in own.groupBy("label").agg(F.count("*").alias("n")).collect()}
    lowest = lambda c: own.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    return lowest(0).unionByName(lowest(1)), sizes
