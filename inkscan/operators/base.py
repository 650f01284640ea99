"""What all detectors share: specifications, scores, and the registry of detectors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from inkscan import rules
from inkscan.functions.regexlib import let


@dataclass(frozen=True)
class Spec:
    id: str
    category: str
    kind: str
    weight: float
    metric: str
    direction: str
    lo: dict[str, float]
    hi: dict[str, float]
    corridor: dict[str, tuple[float, float]]


def specs_of(detectors: list[tuple]) -> dict[str, Spec]:
    return {
        d: Spec(d, category, kind, weight, metric, direction, {"ru": rlo, "en": elo}, {"ru": rhi, "en": ehi}, {"ru": rc, "en": ec})
        for d, category, kind, weight, metric, direction, rlo, rhi, elo, ehi, rc, ec in detectors
    }


SPECS = specs_of(rules.DETECTORS)


def normalised(spec: Spec, value: Column, lang: Column) -> Column:
    """``value`` between the thresholds as 0..1, or 1..0 where less is more."""
    same = spec.lo["ru"] == spec.lo["en"] and spec.hi["ru"] == spec.hi["en"]
    lo = F.lit(spec.lo["en"]) if same else F.when(lang == "ru", spec.lo["ru"]).otherwise(spec.lo["en"])
    hi = F.lit(spec.hi["en"]) if same else F.when(lang == "ru", spec.hi["ru"]).otherwise(spec.hi["en"])
    t = (value - lo) / (hi - lo)
    t = 1 - t if spec.direction == "down" else t
    return F.when(F.isnan(t) | t.isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), t)))


def result(detector: str, value: Column, applicable: Column | None = None, bonus: Column | None = None) -> Column:
    """(value, applicable, score); what does not apply has value and score 0."""
    ok = F.lit(True) if applicable is None else F.coalesce(applicable, F.lit(False))

    def scored(v: Column) -> Column:
        score = normalised(SPECS[detector], v, F.col("lang"))
        if bonus is not None:
            score = F.when(score > 0, F.least(F.lit(1.0), score + bonus)).otherwise(score)
        return F.struct(F.coalesce(v, F.lit(0.0)).alias("value"), v.isNotNull().alias("applicable"), F.when(v.isNotNull(), score).otherwise(0.0).alias("score"))

    return let(F.when(ok, F.coalesce(value.cast("double"), F.lit(0.0))), scored)


def let_result(detector: str, value: Column) -> Column:
    """As ``result``, of a value that is null where the detector does not apply, and is computed once."""
    return let(value, lambda v: result(detector, v, v.isNotNull()))


#: id -> a function that gives the detector's result column over the context's columns; replaced by a later registration.
REGISTRY: dict[str, Callable[[], Column]] = {}
#: Rules of detectors that were registered with a specification of their own, as those of ``rules.ADVICE``.
ADDED_ADVICE: dict[str, list[tuple]] = {}


def register(detector: str, spec: tuple | None = None, advice: list[tuple] | None = None) -> Callable[[Callable[[], Column]], Callable[[], Column]]:
    """Registers a detector; plans built from then on have it.

    A new one brings its ``spec``, a row as those of ``rules.DETECTORS``, and the rules that advise on it: (rule,
    effort, usual gain, autofix).
    """

    def put(f: Callable[[], Column]) -> Callable[[], Column]:
        if spec is not None:
            SPECS.update(specs_of([spec]))
            ADDED_ADVICE[detector] = [(rule, detector, *rest) for rule, *rest in advice or []]
        if detector not in SPECS:
            raise ValueError(f"{detector} has no specification")
        REGISTRY[detector] = f
        return f

    return put


def unregister(detector: str) -> None:
    """Takes a detector out of plans that are built from then on, and what came with it."""
    REGISTRY.pop(detector, None)
    if ADDED_ADVICE.pop(detector, None) is not None:
        SPECS.pop(detector, None)


def registered(kind: str) -> list[str]:
    """The detectors of a kind, in the order of their specifications, as the registry stands."""
    return [d for d, s in SPECS.items() if s.kind == kind and (d in REGISTRY or d == "P-01")]


def advice_rules() -> list[tuple]:
    return [*rules.ADVICE, *(a for added in ADDED_ADVICE.values() for a in added)]


def by_lang(make: Callable[[str], Column]) -> Column:
    return F.when(F.col("lang") == "ru", make("ru")).otherwise(make("en"))


def add_up(columns: list[Column]) -> Column:
    total = columns[0]
    for c in columns[1:]:
        total = total + c
    return total


#: Detectors' columns as built last: the context they were built in, the function, the column.  They name columns of the context and no table.
_BUILT: dict[str, tuple] = {}


def forget_columns() -> None:
    """Columns are built anew: the tables of rules have changed."""
    _BUILT.clear()


def per_detector(ids: list[str]) -> list[Column]:
    """Each detector's result column; a plan of all of them is thousands of calls, so a session builds each once."""
    context, out = SparkContext._active_spark_context, []
    for d in ids:
        had = _BUILT.get(d)
        if had is None or had[0] is not context or had[1] is not REGISTRY[d]:
            had = _BUILT[d] = (context, REGISTRY[d], REGISTRY[d]())
        out.append(had[2].alias(d))
    return out


def as_rows(ids: list[str]) -> Column:
    """An array with a struct per detector: id, category, value, applicable, score."""
    return F.array(*(
        F.struct(F.lit(d).alias("id"), F.lit(SPECS[d].category).alias("category"), F.col(f"`{d}`.value").alias("value"), F.col(f"`{d}`.applicable").alias("applicable"), F.col(f"`{d}`.score").alias("score"))
        for d in ids
    ))
