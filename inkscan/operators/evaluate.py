"""ROC-AUC, false positive rate, F1; calibration; de-duplication and splits of labelled data."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkscan.functions.lineage import cut


#: Rows of a range that one task orders, on average.
RANGE_ROWS = 500_000


def numbered(df: DataFrame, cell: list[str], order: list[str], amount: Column | None = None, name: str = "_place") -> DataFrame:
    """``df`` with the running count (or sum of ``amount``) of each cell before the row, by ``order``.

    The rows are written once, dealt to ranges of (cell, order) whose number follows theirs, so no task orders more
    than its share whatever a cell holds; sums per range and cell are added up.  Rows that tie in
    ``order`` may come in any order.
    """
    spark, amount = df.sparkSession, F.lit(1) if amount is None else amount
    whole = cut(df.withColumn("_amount", amount))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), whole.count() // RANGE_ROWS + 1)
    dealt = cut(whole.repartitionByRange(ranges, *cell, *order).withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy(*cell, "_range").agg(F.sum("_amount").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(*cell or [F.lit(0)]).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*(F.col(c).alias(f"_of_{c}") for c in cell), F.col("_range").alias("_its"), before.alias("_before"))  # ranges x cells
    same = F.col("_range") == F.col("_its")
    for c in cell:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    own = F.coalesce(F.sum("_amount").over(Window.partitionBy(*cell, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = dealt.withColumn("_own", own).join(sums, same).withColumn(name, F.col("_own") + F.col("_before"))
    return out.drop("_range", "_amount", "_own", "_its", "_before", *(f"_of_{c}" for c in cell))


def per_score(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """(by, score, p, n): rows with and without the label per distinct score."""
    return df.groupBy(*by, score).agg(F.sum(F.when(F.col(label), 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label), 0).otherwise(1)).alias("n"))


def auc_of(counts: DataFrame, score: str, by: list[str]) -> DataFrame:
    """(by, auc) from counts per score."""
    wins = numbered(counts, by, [score], F.col("n"), "below").withColumn("wins", F.col("p") * (F.col("below") + F.col("n") / 2.0))
    total = wins.groupBy(*by).agg(F.sum("wins").alias("wins"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return total.select(*by, F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("wins") / (F.col("p") * F.col("n"))).otherwise(0.5).alias("auc"))


def roc_auc(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Mann-Whitney statistic, ties half, by counts per distinct score; 0.5 where a class is empty.

    Rows are first counted per score, so the ordering works on distinct scores and not on rows.
    """
    return auc_of(per_score(df, score, label, by or []), score, by or [])


def threshold_metrics(df: DataFrame, score: str, label: str, threshold: float, by: list[str] | None = None) -> DataFrame:
    """fpr, tpr and f1 at a threshold."""
    hit, yes = F.col(score) >= threshold, F.col(label)
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    n = df.groupBy(*(by or [])).agg(one(hit & yes).alias("tp"), one(hit & ~yes).alias("fp"), one(~hit & yes).alias("fn"), one(~yes).alias("neg"))
    tpr = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    f1 = F.when(F.col("tp") > 0, 2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    return n.select(*(by or []), F.when(F.col("neg") > 0, F.col("fp") / F.col("neg")).otherwise(0.0).alias("fpr"), tpr.alias("tpr"), f1.alias("f1"))


def held_out_report(df: DataFrame, score: str, label: str, groups: list[str | tuple[str, ...]], threshold: float = 65) -> DataFrame:
    """(grouping, member, n, auc, fpr, tpr) for every value of each of ``groups``, such as language, source family, and both.

    One pass over the rows counts them per score for all groupings at once; all figures follow from those counts.
    The members of a grouping by several columns are joined by slashes, as is its name; a null member stays null.
    """
    sets = [(g,) if isinstance(g, str) else tuple(g) for g in groups]
    columns = list(dict.fromkeys(c for g in sets for c in g))
    yes = F.sum(F.when(F.col(label), 1).otherwise(0)).alias("p")
    no = F.sum(F.when(F.col(label), 0).otherwise(1)).alias("n")
    all_ = [*columns, score]
    counted = df.groupingSets([[F.col(c) for c in (*g, score)] for g in sets], *(F.col(c) for c in all_)).agg(F.grouping_id(*all_).alias("_set"), yes, no)
    grouping, member = F.lit(None).cast("string"), F.lit(None).cast("string")
    for g in sets:  # a bit per column that the set leaves out
        code = sum(1 << (len(all_) - 1 - i) for i, c in enumerate(all_) if c not in (*g, score))
        grouping = F.when(F.col("_set") == code, "/".join(g)).otherwise(grouping)
        own = F.col(g[0]).cast("string") if len(g) == 1 else F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in g))
        member = F.when(F.col("_set") == code, own).otherwise(member)
    counts = cut(counted.select(grouping.alias("grouping"), member.alias("member"), F.col(score).alias("_score"), "p", "n"))
    hit, by = F.col("_score") >= threshold, ["grouping", "member"]
    sums = counts.groupBy(*by).agg(F.sum("p").alias("pos"), F.sum("n").alias("neg"), F.sum(F.when(hit, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("fp"))
    share = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)
    auc = auc_of(counts, "_score", by).select(F.col("grouping").alias("_g"), F.col("member").alias("_m"), "auc")
    rows = sums.join(auc, (F.col("grouping") == F.col("_g")) & F.col("member").eqNullSafe(F.col("_m")))
    return rows.select(*by, (F.col("pos") + F.col("neg")).alias("n"), "auc", share("fp", "neg").alias("fpr"), share("tp", "pos").alias("tpr"))


def fit_logistic(x: np.ndarray, y: np.ndarray, sample_weights: np.ndarray | None = None, l2: float = 0.02, rate: float = 0.5, epochs: int = 4000) -> tuple[float, np.ndarray]:
    """Logistic regression with weights of at least 0, by projected gradient steps; for a bounded sample."""
    s = np.ones(len(y)) if sample_weights is None else sample_weights
    total = s.sum() or 1.0
    w, b = np.full(x.shape[1], 0.5), 0.0
    for _ in range(epochs):
        error = (1 / (1 + np.exp(-(x @ w + b))) - y) * s
        b, w = b - rate * error.sum() / total, np.maximum(0, w - rate * (x.T @ error / total + l2 * w))
    return float(b), w


def clamp_bias(bias: float, human: np.ndarray) -> float:
    """A bias at which 95 % of human texts stay under a score of 65."""
    z = np.sort(human)
    return min(bias, float(np.log(65 / 35) - z[int(0.95 * len(z))])) if len(z) else bias


def bias_limit(df: DataFrame, z: str, by: list[str], bias: float) -> DataFrame:
    """(by, bias): the least of ``bias`` and the one at which 95 % of the rows, all by people, stay under a score of 65.

    The row at the 95th percentile is picked by its exact place; no group is ordered in one task.
    """
    n = df.groupBy(*(F.col(c).alias(f"_n_{c}") for c in by)).agg(F.count("*").alias("_n"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_n_{c}"))
    picked = numbered(df.select(*by, z), by, [z]).join(n, same).where(F.col("_place") == F.floor(F.col("_n") * 0.95))
    return picked.select(*by, F.least(F.lit(float(bias)), F.log(F.lit(65 / 35)) - F.col(z)).alias("bias"))


def seeded(*columns: Column, seed: int = 42) -> Column:
    """A pseudo-random order that depends on the columns alone."""
    return F.xxhash64(F.lit(seed), *columns)


def leave_one_out(x: np.ndarray, y: np.ndarray, **how: float) -> np.ndarray:
    """The score of every row by weights fitted without it; for a bounded sample."""
    out = np.zeros(len(y))
    for i in range(len(y)):
        rest = np.arange(len(y)) != i
        b, w = fit_logistic(x[rest], y[rest], **how)
        out[i] = 100 / (1 + np.exp(-(x[i] @ w + b)))
    return out


def dedupe_by_prefix(df: DataFrame, order: str, text: str = "text", prefix: int = 200) -> DataFrame:
    """The first row by ``order`` of those whose texts begin alike; null texts begin alike too.

    One row per beginning is gathered in part before it moves; of rows that tie, one stays.
    """
    row = F.struct(*df.columns)
    first = df.groupBy(F.substring(text, 1, prefix).alias("_key")).agg(F.min_by(row, F.col(order)).alias("_row"), F.first(row).alias("_any"))
    return first.select(F.coalesce("_row", "_any").alias("_row")).select("_row.*")


def of_length(df: DataFrame, least: int = 400, most: int = 4000, text: str = "text") -> DataFrame:
    return df.where(F.length(text).between(least, most))


def build_dataset(df: DataFrame, cell: list[str], order: str, cap: int, text: str = "text", every: int = 5) -> DataFrame:
    """Texts of 400 to 4000 characters, one of those that begin alike, at most ``cap`` of each cell, with ``is_test``."""
    some = dedupe_by_prefix(of_length(df, text=text), order, text)
    return stratified_split(capped(some.withColumn("_seed", seeded(F.col(order))), cell, ["_seed", order], cap).drop("_seed"), cell, [order], every)


def stratified_split(df: DataFrame, cell: list[str], order: list[str], every: int = 5) -> DataFrame:
    """``is_test`` for every fifth row of each cell."""
    return numbered(df, cell, order).withColumn("is_test", F.col("_place") % every == every - 1).drop("_place")


def capped(df: DataFrame, cell: list[str], order: list[str], most: int) -> DataFrame:
    """At most ``most`` rows of each cell; this is a sampling operator."""
    place = F.row_number().over(Window.partitionBy(*cell).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")
