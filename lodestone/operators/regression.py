"""Linear regression by gradient descent."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_features(rows: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """response and vector (1, x) for a line y = w0 + w1 * x."""
    return rows.select(F.col(y).cast("double").alias("response"), F.array(F.lit(1.0), F.col(x).cast("double")).alias("vector"))


def _dot(weights: list[float]) -> Column:
    out = F.lit(0.0)
    for j, w in enumerate(weights):
        out = out + F.lit(float(w)) * F.get("vector", F.lit(j))
    return out


def gradient_step(features: DataFrame, weights: list[float], alpha: float) -> DataFrame:
    """One row, one column `weights`: each weight less alpha times the mean of its slope; no row for no features. One pass of partial sums."""
    diff = _dot(weights) - F.col("response")
    sums = features.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("vector", F.lit(j)) * diff).alias(f"s{j}") for j in range(len(weights))]).filter("n > 0")
    return sums.select(F.array(*[F.lit(float(w)) - (F.lit(float(alpha)) / F.col("n")) * F.col(f"s{j}") for j, w in enumerate(weights)]).alias("weights"))


def run_steps(features: DataFrame, weights: list[float], alpha: float, steps: int) -> list[list[float]]:
    """The weights after each step; each step is one job over the features."""
    out = []
    for _ in range(steps):
        row = gradient_step(features, weights, alpha).first()
        if row is None:
            break
        weights = list(row["weights"])
        out.append(weights)
    return out


def fit(features: DataFrame, dimensions: int, alpha: float = 0.1, start: list[float] | None = None, norm: str = "sq_l2", tol: float | None = None, max_steps: int = 10_000, seed: int = 0, least_steps: int = 2) -> tuple[list[float], int]:
    """Weights and the number of steps until a step is small: norm "sq_l2" (tol 1e-5) or "l2" (tol 1e-3). Starts at random weights unless given."""
    if norm not in ("sq_l2", "l2"):
        raise ValueError("norm is sq_l2 or l2")
    tol = tol if tol is not None else (10e-6 if norm == "sq_l2" else 1e-3)
    draw = random.Random(seed)
    weights = list(start) if start is not None else [draw.random() for _ in range(dimensions)]
    features = features.persist()
    try:
        for step in range(1, max_steps + 1):
            new = run_steps(features, weights, alpha, 1)
            if not new:
                return weights, step - 1
            moved = sum((a - b) ** 2 for a, b in zip(new[0], weights, strict=True))
            weights = new[0]
            if step >= least_steps and (moved if norm == "sq_l2" else math.sqrt(moved)) < tol:
                break
        return weights, step
    finally:
        features.unpersist()
