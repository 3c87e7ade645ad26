"""Rows a classifier may learn from, and a one-dimensional calibration of its scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id as text leaves ``remainder``; a null id is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def learned_labels(labels: DataFrame, label_col: str, modulus: int, remainder: int, id_col: str = "doc_id") -> DataFrame:
    """(id, y) of the rows open to learning: one row per id, 1 if any of its labels is 1; null labels go."""
    rows = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col, modulus, remainder))
    return rows.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))


def fit_sigmoid(t: np.ndarray, positive: np.ndarray, negative: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve through counts at points ``t`` (ridge-stabilised, damped Newton steps)."""
    n = positive + negative
    if positive.sum() == 0 or negative.sum() == 0:
        return 1.0, 0.0
    x = np.stack([t, np.ones_like(t)])
    w = np.array([0.0, np.log(positive.sum() / negative.sum())])
    loss = lambda w: float(positive @ np.logaddexp(0, -(w @ x)) + negative @ np.logaddexp(0, w @ x) + 0.5e-3 * w[0] * w[0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))) @ x.T + np.diag([1e-3, 1e-6]), x @ (positive - n * p) - np.array([1e-3, 0]) * w)
        step = np.clip(step, -2, 2)
        for _ in range(30):  # a full step may overshoot where few rows separate the classes
            if loss(w + step) <= loss(w):
                w = w + step
                break
            step = step / 2
    return max(float(w[0]), 1e-6), float(w[1])  # never turns the order of the scores


def calibrated(scored: DataFrame, labels: DataFrame, value: Column, grain: float = 20.0) -> tuple[float, float]:
    """Curve of the labels over ``value``: one pass that counts labels in steps of 1/``grain``; the steps number some
    hundreds because ``value`` is a logarithm."""
    step = F.round(value * grain).cast("int").alias("step")
    rows = scored.select("id", step).join(labels, "id").groupBy("step").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n")).collect()
    get = lambda k: np.array([float(r[k]) for r in rows])
    return fit_sigmoid(get("step") / grain, get("p"), get("n")) if rows else (1.0, 0.0)
