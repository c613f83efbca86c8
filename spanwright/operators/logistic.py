"""Logistic fits by full-batch gradient descent over a histogram of the rows.

Rows are counted by their feature values and label first, so a step costs one
pass over the different values whatever the number of rows. Up to CELLS of them
the histogram (not the rows) is brought to the driver and all steps are taken
there; with more, each step is one job that sums the gradients in the tasks and
brings one row to the driver. Both take the same steps from the same start.

Defined cases: rows with a null label or feature take no part; without rows, or
with labels of one kind only, the fit is what the steps give (weights that only
follow the bias); a feature without spread is scaled by 1; an empty table gives
weights and bias of 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Different feature values up to which the histogram is fitted in the driver (8 MB at 30 features).
CELLS = 32_768


@dataclass(frozen=True)
class Fit:
    features: tuple[str, ...]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def column(self) -> Column:
        """The probability of a row that has the features."""
        z = F.lit(self.bias)
        for name, m, s, w in zip(self.features, self.mean.tolist(), self.scale.tolist(), self.weights.tolist(), strict=True):
            z = z + F.lit(w) * ((F.col(name) - F.lit(m)) / F.lit(s))
        return 1 / (1 + F.exp(-z))


def histogram(rows: DataFrame, features: list[str], label: str, weight: str | None = None) -> DataFrame:
    """The features as doubles, y, n (rows) and w (their weight) of each different row."""
    w = F.sum(weight).cast("double") if weight else F.count("*").cast("double")
    known = rows.dropna(subset=[*features, label])
    keys = [F.col(f).cast("double").alias(f) for f in features]
    return known.groupBy(*keys, F.col(label).cast("double").alias("y")).agg(F.count("*").cast("double").alias("n"), w.alias("w"))


def _moments(cells: DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean and spread of each feature over rows, whatever their weight, and the total weight; two passes, so that large means lose no digits."""
    row = cells.agg(F.sum("n").alias("n"), F.sum("w").alias("w"), *[F.sum(F.col("n") * F.col(f)).alias(f) for f in features]).first()
    n, total = row["n"] or 0.0, row["w"] or 0.0
    mean = np.array([(row[f] or 0.0) / n if n else 0.0 for f in features])
    row = cells.agg(*[F.sum(F.col("n") * F.pow(F.col(f) - F.lit(m), F.lit(2.0))).alias(f) for f, m in zip(features, mean.tolist(), strict=True)]).first()
    scale = np.array([np.sqrt((row[f] or 0.0) / n) if n else 0.0 for f in features])
    return mean, np.where(scale > 0, scale, 1.0), total


def _gradient(z: np.ndarray, y: np.ndarray, w: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """Sums of the error, and of the error times each feature."""
    with np.errstate(over="ignore"):
        error = (1 / (1 + np.exp(-(z @ weights + bias))) - y) * w
    return np.append(z.T @ error, error.sum())


def fit(rows: DataFrame, features: list[str], label: str, weight: str | None = None, steps: int = 1500, rate: float = 0.5, l2: float = 1e-3, cells_in_driver: int = CELLS) -> Fit:
    """Weights of standardised features that ``steps`` steps of gradient descent from zero reach, with an L2 penalty on all but the bias."""
    cells = histogram(rows, features, label, weight).persist()
    try:
        mean, scale, total = _moments(cells, features)
        weights, bias = np.zeros(len(features)), 0.0
        if total:
            few = cells.limit(cells_in_driver + 1).count() <= cells_in_driver
            if few:
                table = cells.toPandas()
                z, y, w = (table[features].to_numpy(float) - mean) / scale, table["y"].to_numpy(), table["w"].to_numpy()
            for _ in range(steps):
                g = _gradient(z, y, w, weights, bias) if few else _summed(cells, features, mean, scale, weights, bias)
                bias -= rate * g[-1] / total
                weights = weights - rate * (g[:-1] / total + l2 * weights)
        return Fit(tuple(features), mean, scale, weights, float(bias))
    finally:
        cells.unpersist()


def _summed(cells: DataFrame, features: list[str], mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """The gradient of one step, summed in the tasks."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in it:
            z = (part[features].to_numpy(float) - mean) / scale
            yield pd.DataFrame([_gradient(z, part["y"].to_numpy(), part["w"].to_numpy(), weights, bias)], columns=names)

    names = [f"g{i}" for i in range(len(features) + 1)]
    sums = cells.mapInPandas(run, ", ".join(f"{n} double" for n in names)).agg(*[F.sum(n).alias(n) for n in names]).first()
    return np.array([sums[n] for n in names])


def platt(rows: DataFrame, score: str, label: str, steps: int = 3000, rate: float = 0.1) -> Fit:
    """The logistic curve of one score: a logistic fit without a penalty."""
    return fit(rows, [score], label, steps=steps, rate=rate, l2=0.0)


def diagnostics(rows: DataFrame, probability: str, label: str, bins: int = 10) -> DataFrame:
    """One row, brier and expected_calibration_error: the mean squared error, and the mean gap between probability and share of positives by bins of equal width."""
    p, y = F.col(probability), F.col(label).cast("double")
    cell = rows.groupBy(F.least(F.lit(bins - 1), F.floor(p * bins)).alias("bin")).agg(F.count("*").alias("n"), F.sum(p).alias("p"), F.sum(y).alias("y"), F.sum((p - y) * (p - y)).alias("e"))
    total = F.sum("n")
    return cell.agg((F.sum("e") / total).alias("brier"), (F.sum(F.abs(F.col("p") - F.col("y"))) / total).alias("expected_calibration_error"))
