"""Labelled rows for the classifiers: held-out rule, bounded training sample, calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

#: Bound of the labelled sample that a classifier is fitted on, by class. Statistics of the labels cover all labels.
SAMPLE = 2000


def remainder(modulus: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus`` (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def training_rows(docs: DataFrame, labels: DataFrame, target: str, allowed: Column, per_class: int = SAMPLE) -> tuple[DataFrame, dict[int, int]]:
    """``(doc_id, y int, text binary)`` of at most ``per_class`` labelled rows a class, and all labels' counts.

    Rows where ``allowed`` (over doc_id) doesn't hold are never read as labels. The rows of smallest id hash are
    taken, so that the sample is the same at each run. Ids with contradicting labels and null labels don't count.
    """
    known = labels.filter(allowed & F.col(target).isin(0, 1)).groupBy("doc_id").agg(F.min(target).cast("int").alias("y"), F.max(target).cast("int").alias("other")).filter("y = other").select("doc_id", "y")
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    chosen = parts[0].union(parts[1])  # at most 2 * per_class rows: small enough to broadcast
    rows = docs.select("doc_id", text_bytes().alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.select("doc_id", "y", "text").dropDuplicates(["doc_id"]), counts


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights (the bias last) of a ridge-penalised logistic regression, by Newton's method; classes weigh alike."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    b, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ b)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty) + 1e-9 * np.eye(len(b)), x.T @ (weight * (p - y)) + penalty * b)
        b = b - step * min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return b


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def prior_shift(counts: dict[int, int]) -> float:
    """What to add to a balanced fit's log-odds so that they follow the classes' shares among all labels."""
    return float(np.log(counts[1] / counts[0])) if counts.get(0) and counts.get(1) else 0.0
