"""What the two learned operators share: the bounded training sample and the calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlake.llm.common import held_out, text_of


def training_rows(docs: DataFrame, labels: DataFrame, label: str, bound: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, label of at most bound labelled rows outside the held-out fold.

    The bound keeps the driver's model fitting of fixed size; ids are taken in the order of their hash."""
    known = labels.where(~held_out(id_col) & F.col(label).isin(0, 1)).select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("label"))
    chosen = known.dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")  # bound rows of two numbers


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 40, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights and, last, the intercept, by Newton's method; the intercept isn't penalised."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.ones(len(x)) if weight is None else weight
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - ridge * w
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
