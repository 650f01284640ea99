"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Statistics of whole texts become smoothed log rates, so a short text lies near the corpus and not at
an extreme.  Each class is a normal distribution over them.  Its covariance shrinks towards the
pooled one, the more the fewer rows the class has, and then towards a multiple of the identity
(``POOL_ROWS``, ``ROUND``).  The score of a text is the logistic function of the difference of the
two log densities, each a Mahalanobis distance through the class's Cholesky factor, whose inverse is
computed once with the fit, plus the log of the classes' shares.

Nothing is sampled: counts, sums and products of the features of all labelled rows are added up in
Spark, as whole numbers, so that the order of tasks can't move the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkscan.llm.langid import held_out
from inkscan.llm.quality import COUNTS, MORE, with_statistics
from inkscan.llm.shared import cut

#: A class's covariance is pooled as if the pooled one were so many rows more; the share of the identity in it.
POOL_ROWS, ROUND = 100, 0.02
#: A document is predicted good if its score is at least this.
GOOD_AT = 0.7
#: Features are whole numbers of this fraction while they are added up.
STEP = 1.0 / 4096

#: Rates (log((count + p * k) / (base + k))): count, base, what is expected (p), and how many units of the base that expectation weighs (k).
RATES: tuple[tuple[str, str, float, float], ...] = (
    ("word_chars", "n_words", 5.0, 8.0),
    ("n_symbols", "n_points", 0.002, 200.0),
    ("n_dup_lines", "n_lines", 0.02, 5.0),
    ("n_repeat_words", "n_words", 0.01, 50.0),
    ("n_digits", "n_points", 0.005, 200.0),
    ("n_upper", "n_points", 0.03, 200.0),
    ("n_stops", "n_words", 0.1, 40.0),
    ("n_distinct", "n_words", 0.7, 20.0),
    ("n_words", "n_lines", 15.0, 2.0),
)
WIDTH = 1 + len(RATES)


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """A row of finite features per text, in steps of ``STEP``; an empty text has those of the expectations."""
    s = {k: np.asarray(v, dtype=np.float64) for k, v in s.items()}
    columns = [np.log1p(s["n_words"]), *(np.log((s[count] + p * k) / (s[base] + k)) for count, base, p, k in RATES)]
    return np.rint(np.stack(columns, axis=1) / STEP) * STEP


@dataclass(frozen=True)
class Normal:
    """A class: mean, inverse of the Cholesky factor of its covariance, and log of its share over the root of the determinant."""

    mean: np.ndarray
    inverse: np.ndarray
    offset: float

    def log_density(self, x: np.ndarray) -> np.ndarray:
        away = (x - self.mean) @ self.inverse.T
        return self.offset - 0.5 * (away * away).sum(axis=1)


@dataclass(frozen=True)
class Discriminant:
    """Two classes, or a constant score where the labelled rows don't hold both."""

    bad: Normal | None
    good: Normal | None
    constant: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.bad is None or self.good is None:
            return np.full(len(x), self.constant)
        apart = self.good.log_density(x) - self.bad.log_density(x)
        return 1 / (1 + np.exp(-np.clip(apart, -700, 700)))


def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], pool_rows: float = POOL_ROWS, round_: float = ROUND) -> Discriminant:
    """From (rows, mean, covariance) of class 0 and class 1."""
    n = {k: sums[k][0] if k in sums else 0.0 for k in (0, 1)}
    if not n[0] or not n[1]:
        return Discriminant(None, None, (n[1] + 1) / (n[0] + n[1] + 2))
    pooled = (n[0] * sums[0][2] + n[1] * sums[1][2]) / (n[0] + n[1])
    # units in which the pooled features vary alike, so that the identity is a fair shape to shrink to
    unit = np.sqrt(np.maximum(np.diag(pooled), STEP * STEP))
    classes = []
    for k in (0, 1):
        rows, mean, own = sums[k]
        part = pool_rows / (pool_rows + rows)
        shape = ((1 - part) * own + part * pooled) / np.outer(unit, unit)
        shape = (1 - round_) * shape + round_ * max(np.trace(shape) / len(unit), STEP) * np.eye(len(unit))
        factor = np.linalg.cholesky(shape)
        inverse = np.linalg.inv(factor) / unit  # whitens x - mean
        classes.append(Normal(mean, inverse, float(np.log(rows / (n[0] + n[1])) - np.log(np.diag(factor)).sum())))
    return Discriminant(*classes)


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch and class: 1, the features and their products, added up as whole numbers of steps."""
    upper = np.triu_indices(WIDTH)
    for batch in batches:
        label = batch.column("quality").to_numpy(zero_copy_only=False)
        x = np.rint(features({c: batch.column(c).to_numpy() for c in (*COUNTS, *MORE)}) / STEP).astype(np.int64)
        for k in np.unique(label):
            own = x[label == k]
            products = (own.T @ own)[upper]
            values = [len(own), *own.sum(axis=0).tolist(), *products.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([values], pa.list_(pa.int64()))], names=["quality", "sums"])


def train(statistics: DataFrame, labels: DataFrame, pool_rows: float = POOL_ROWS, round_: float = ROUND) -> Discriminant:
    """The discriminant of all labelled rows of ``statistics`` (doc_id and the counts) that aren't held out.

    Labels other than 0 and 1 are ignored; of several labels of an id the greatest counts, and a
    label counts for every row of its id.  One row per class and feature pair comes to the driver.
    """
    chosen = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("quality"))
    rows = statistics.where(~held_out(F.col("doc_id"))).join(chosen, "doc_id").select("quality", *COUNTS, *MORE)
    partial = rows.mapInArrow(_partial_sums, "quality int, sums array<long>")
    total = partial.select("quality", F.posexplode("sums")).groupBy("quality", "pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("total")).collect()
    by_class: dict[int, list[Decimal]] = {}
    for row in sorted(total, key=lambda r: (r["quality"], r["pos"])):
        by_class.setdefault(row["quality"], []).append(row["total"])
    upper, found = np.triu_indices(WIDTH), {}
    for k, values in by_class.items():
        n, sums, products = int(values[0]), [int(v) for v in values[1 : 1 + WIDTH]], [int(v) for v in values[1 + WIDTH :]]
        # n * products - sums * sums is exact in whole numbers; only the last division rounds
        spread = np.zeros((WIDTH, WIDTH))
        for i, j, p in zip(*upper, products, strict=True):
            spread[i, j] = spread[j, i] = (n * p - sums[i] * sums[j]) / (n * n)
        found[k] = (float(n), np.array([v / n for v in sums]) * STEP, spread * STEP * STEP)
    return fit(found, pool_rows, round_)


def judge(statistics: DataFrame, model: Discriminant, good_at: float = GOOD_AT) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``statistics``."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.score(features({c: batch.column(c).to_numpy() for c in (*COUNTS, *MORE)}))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    scored = statistics.select("doc_id", *COUNTS, *MORE).mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= good_at).cast("int").alias("predicted"))


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= 0.7).

    Whole texts are read once; their counts are a written table from which the fit and the scores
    are taken.  A null text counts as empty, and an empty one is scored by the expectations of its
    rates and its length.  Rows that repeat an id are scored each.  A null id is not held out and
    has no label.  Without labels of both classes the score is a constant.  Other columns, of
    whatever name, are ignored; an empty table gives no rows.
    """
    statistics = cut(with_statistics(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"]))
    return judge(statistics, train(statistics, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")))
