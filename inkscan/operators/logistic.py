"""Logistic regression with weights of at least 0, fitted over all rows of a table, and scores by the fit without each row.

A step takes one aggregate over the rows: the gradient and the curvature of the loss, added up from each
partition's batches.  What comes to the driver has a row per pair of features.  The driver
solves the step's small bounded problem, so some ten passes reach the minimum that thousands of
gradient steps approach.  Leaving a row out moves the fit by its influence, which follows from
the same curvature: no refit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkscan.functions.lineage import cut

#: Largest slope, over the weights that may move, at which a fit is done; passes at most.
SLOPE, PASSES = 1e-10, 100
ROWS = "x array<double>, y double, w double"


@dataclass(frozen=True)
class Fit:
    """A fitted model: bias, a weight per feature, and what the last pass found at them."""

    bias: float
    weights: np.ndarray
    slope: np.ndarray  # of the penalised mean loss: bias first
    curvature: np.ndarray
    total: float  # sum of the rows' weights
    passes: int

    @property
    def free(self) -> np.ndarray:
        """Bias and the features whose weight is not held at 0."""
        return np.concatenate([[True], self.weights > 0])


def feature_rows(df: DataFrame, features: list[Column], label: Column, weight: Column | None = None) -> DataFrame:
    """(x, y, w): null features count as 0; rows without a label, or of weight 0 or none, are left out."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    rows = df.select(F.array(*(F.coalesce(f.cast("double"), F.lit(0.0)) for f in features)).alias("x"), label.cast("double").alias("y"), w.alias("w"))
    return rows.where("y is not null and w > 0")


def _loss_sums(bias: float, weights: np.ndarray):
    upper = np.triu_indices(len(weights) + 1)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + len(weights) + 1 + len(upper[0]))
        for batch in batches:
            if not len(batch):
                continue
            x = np.column_stack([np.ones(len(batch)), np.asarray(batch.column("x").flatten()).reshape(len(batch), -1)])
            y, w = (batch.column(c).to_numpy() for c in ("y", "w"))
            z = x @ np.concatenate([[bias], weights])
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            curve = (x * (w * p * (1 - p))[:, None]).T @ x
            loss = float((w * (np.logaddexp(0, z) - y * z)).sum())
            total += np.concatenate([[w.sum(), loss], x.T @ (w * (p - y)), curve[upper]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

    return add


def _pass(rows: DataFrame, bias: float, weights: np.ndarray, l2: float) -> tuple[float, np.ndarray, np.ndarray, float]:
    """(loss, slope, curvature, sum of row weights) of the penalised mean loss over all rows."""
    sums = rows.mapInArrow(_loss_sums(bias, weights), "sums array<double>").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("s"))
    values = np.array([r["s"] for r in sorted(sums.collect(), key=lambda r: r["pos"])])  # a row per pair of features
    d, total = len(weights) + 1, values[0] if len(values) else 0.0
    if not total:
        return 0.0, np.zeros(d), np.eye(d), 0.0
    curvature, upper = np.zeros((d, d)), np.triu_indices(d)
    curvature[upper] = values[2 + d :] / total
    curvature = curvature + curvature.T - np.diag(np.diag(curvature))
    inner = np.concatenate([[0.0], weights])
    slope = values[2 : 2 + d] / total + l2 * inner
    return values[1] / total + 0.5 * l2 * float(weights @ weights), slope, curvature + l2 * np.diag([0.0] + [1.0] * (d - 1)), total


def _bounded_step(at: np.ndarray, slope: np.ndarray, curvature: np.ndarray) -> np.ndarray:
    """Where the quadratic model is least with all but the first coordinate at least 0, by descent along coordinates."""
    new = at.copy()
    curvature = curvature + 1e-12 * np.eye(len(at))
    for _ in range(10_000):
        moved = 0.0
        for j in range(len(at)):
            to = new[j] - (slope[j] + curvature[j] @ (new - at)) / curvature[j, j]
            to = to if j == 0 else max(0.0, to)
            moved = max(moved, abs(to - new[j]))
            new[j] = to
        if moved < 1e-14:
            break
    return new


def fit(rows: DataFrame, l2: float = 0.002) -> Fit:
    """The bounded minimum of the weighted mean log loss plus l2 / 2 times the squared weights, over all ``rows`` (x, y, w).

    Without rows the bias and all weights are 0.  Where all labels agree and so the bias has no
    minimum, it stops at a loss that no pass lowers any more.
    """
    rows = cut(rows.select("x", "y", "w"))
    first = rows.first()
    d = len(first["x"]) if first is not None else 0
    at = np.zeros(d + 1)
    loss, slope, curvature, total = _pass(rows, at[0], at[1:], l2)
    passes = 1
    while total and passes < PASSES:
        held = np.concatenate([[False], (at[1:] <= 0) & (slope[1:] > 0)])
        if np.abs(slope[~held]).max() <= SLOPE:
            break
        to, step = _bounded_step(at, slope, curvature), 1.0
        while True:  # a full step may overshoot far from the minimum
            tried = at + step * (to - at)
            found = _pass(rows, tried[0], tried[1:], l2)
            passes += 1
            if found[0] <= loss + 1e-15 or step < 1e-6 or passes >= PASSES:
                break
            step /= 2
        done = found[0] >= loss - 1e-15 and np.abs(tried - at).max() < 1e-9
        at, (loss, slope, curvature, total) = tried, found
        if done:
            break
    return Fit(float(at[0]), at[1:], slope, curvature, total, passes)


def scored(df: DataFrame, model: Fit, features: list[Column], name: str = "z") -> DataFrame:
    """``df`` with its logit."""
    z = F.lit(model.bias)
    for f, w in zip(features, model.weights.tolist(), strict=True):
        if w:
            z = z + F.coalesce(f.cast("double"), F.lit(0.0)) * w
    return df.withColumn(name, z)


def leave_one_out(df: DataFrame, model: Fit, features: list[Column], label: Column, weight: Column | None = None, name: str = "score_without") -> DataFrame:
    """``df`` with the score (0 to 100) that its row would get from a fit without it.

    One step from the fit in hand, by the row's leverage: the logit moves against its own residual, the
    more the more the row alone holds the fit.  Features at the bound stay there.  Columns of Spark only.
    """
    free = np.flatnonzero(model.free)
    inverse = np.linalg.inv(model.curvature[np.ix_(free, free)]) / max(model.total, 1.0)
    x = [F.lit(1.0) if j == 0 else F.coalesce(features[j - 1].cast("double"), F.lit(0.0)) for j in free]
    # x' A x through the factor of A: a square per free feature
    factor = np.linalg.cholesky(inverse)
    reach = F.lit(0.0)
    for k in range(len(free)):
        side = F.lit(0.0)
        for j in range(k, len(free)):
            side = side + x[j] * float(factor[j, k])
        reach = reach + side * side
    w = F.lit(1.0) if weight is None else weight.cast("double")
    out = scored(df, model, features, "_z").withColumn("_reach", reach * w).withColumn("_p", 1 / (1 + F.exp(-F.col("_z"))))
    rest = F.greatest(1 - F.col("_p") * (1 - F.col("_p")) * F.col("_reach"), F.lit(1e-6))
    moved = F.col("_z") + (F.col("_p") - label.cast("double")) * F.col("_reach") / rest
    return out.withColumn(name, 100 / (1 + F.exp(-moved))).drop("_z", "_reach", "_p")
