"""Weights of the model from labelled texts, over all of them, and the bias that keeps people's texts apart."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkscan.operators.evaluate import numbered
from inkscan.operators.logistic import feature_rows, fit


def calibrate(results: DataFrame, label: str, ids: list[str], l2: float = 0.002, weight: str | None = None) -> tuple[float, dict[str, float]]:
    """Bias and weights of at least 0; what does not apply counts as 0, and 95 % of negatives stay under 65.

    All rows count, in some ten passes.  The bias is the least of the fitted one and of that at which the row at the
    95th percentile of the negatives, picked by its exact place, has a score of 65.  Rows without a label are left out.
    """
    features = [F.col(f"`{d}`.score") for d in ids]
    model = fit(feature_rows(results, features, F.col(label).cast("int"), None if weight is None else F.col(weight)), l2)
    rounded = np.round(model.weights, 4)
    z = F.lit(0.0)
    for f, w in zip(features, rounded.tolist(), strict=False):
        z = z + F.coalesce(f, F.lit(0.0)) * w
    negatives = results.where(F.col(label).cast("int") == 0).select(z.alias("_z"))
    n = negatives.count()
    bias = model.bias
    if n:
        top = numbered(negatives, [], ["_z"]).where(F.col("_place") == int(0.95 * n)).first()["_z"]
        bias = min(bias, math.log(65 / 35) - top)
    return round(bias, 4), dict(zip(ids, rounded.tolist(), strict=False)) if len(rounded) else dict.fromkeys(ids, 0.0)
