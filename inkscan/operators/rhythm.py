"""R-01 to R-05: how sentence and paragraph lengths vary, and how sentences open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkscan.functions.regexlib import cv, let, mean, share
from inkscan.operators.base import let_result, register, result


def lengths() -> Column:
    return F.transform("prose", lambda s: s["n"].cast("double"))


def updated_cv(numbers: Column) -> Column:
    """Population deviation over mean, the deviation updated from the last number to the first, as the SQL's engine does.

    Two ways of adding up differ in the last digit, which decides where a score lies on a border.
    """
    none = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))

    def step(acc: Column, x: Column) -> Column:
        put = lambda m: F.struct((acc["n"] + 1).alias("n"), m.alias("mean"), (acc["squares"] + (x - m) * (x - acc["mean"])).alias("squares"))
        return let(acc["mean"] + (x - acc["mean"]) / (acc["n"] + 1), put)

    def of(v: Column) -> Column:
        spread = F.aggregate(F.reverse(v), none, step, lambda acc: F.sqrt(acc["squares"] / acc["n"]))
        return let(mean(v), lambda m: F.when(m != 0, spread / m).otherwise(0.0))

    return let(numbers, of)


def autocorrelation(x: Column, m: Column, lag: int) -> Column:
    n = F.size(x)
    spread = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - m) * (v - m))
    pairs = F.zip_with(F.slice(x, F.lit(1), n - lag), F.slice(x, F.lit(lag + 1), n - lag), lambda a, b: (a - m) * (b - m))
    together = F.aggregate(pairs, F.lit(0.0), lambda a, v: a + v)
    return F.when(n > lag + 2, let(spread, lambda d: F.when(d > 0, together / d).otherwise(0.0))).otherwise(0.0)


@register("R-01")
def burstiness() -> Column:
    return result("R-01", updated_cv(lengths()), F.size("prose") >= 5)


@register("R-02")
def extremes() -> Column:
    far = share(lambda s: (s["n"] <= 5) | (s["n"] >= 35), F.col("prose"))
    return result("R-02", far, F.size("prose") >= 5)


@register("R-03")
def even_paragraphs() -> Column:
    blocks = F.filter("paras", lambda p: (p["kind"] == "text") & (F.size(p["sents"]) > 0))
    sizes = F.transform(blocks, lambda p: F.struct(F.size(p["sents"]).alias("sents"), F.aggregate(p["sents"], F.lit(0.0), lambda a, s: a + s["n"]).alias("words")))

    def even(v: Column) -> Column:
        few = share(lambda p: p["sents"].between(3, 4), v)
        return F.when(F.size(v) >= 3, cv(F.transform(v, lambda p: p["words"])) * (1 - 0.4 * F.greatest(F.lit(0.0), few - 0.5)))

    return let_result("R-03", let(sizes, even))


@register("R-04")
def rhythm() -> Column:
    most = let(lengths(), lambda x: let(mean(x), lambda m: F.greatest(F.lit(-1.0), *(autocorrelation(x, m, lag) for lag in (2, 3, 4)))))
    return result("R-04", most, F.size("prose") >= 9)


@register("R-05")
def openings() -> Column:
    start = F.struct(F.lit("").alias("word"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, w: Column) -> Column:
        run = F.when(acc["word"] == w, acc["run"] + 1).otherwise(1)
        return F.struct(w.alias("word"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    def value(firsts: Column) -> Column:
        n = F.size(firsts)
        top = F.aggregate(F.sort_array(firsts), start, step, lambda acc: acc["best"])
        pairs = F.zip_with(F.slice(firsts, F.lit(1), n - 1), F.slice(firsts, F.lit(2), n - 1), lambda a, b: a == b)
        return F.when(n >= 6, F.least(F.lit(1.0), top / n + 0.5 * F.size(F.filter(pairs, lambda x: x)) / n))

    return let_result("R-05", let(F.transform("prose", lambda s: s["first"]), value))
