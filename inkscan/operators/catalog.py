"""The rule tables as a DataFrame, and other tables in their place while plans are built."""

from __future__ import annotations

import json
import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from inkscan import rules
from inkscan.operators import base
from inkscan.operators.checks import faults

_ONE = threading.RLock()
CATALOG = "id string, category string, kind string, weight double, metric string, direction string, corridor_ru array<double>, corridor_en array<double>, rules array<string>"


def catalog(spark: SparkSession) -> DataFrame:
    """A row per detector, with the rules that advise on it."""
    rows = [
        (d, category, kind, float(weight), metric, direction, list(map(float, ru)), list(map(float, en)), [r for r, of, *_ in rules.ADVICE if of == d])
        for d, category, kind, weight, metric, direction, _, _, _, _, ru, en in rules.DETECTORS
    ]
    return spark.createDataFrame(rows, CATALOG)


@contextmanager
def using(**tables) -> Iterator[None]:
    """Plans built inside use ``tables`` instead of those of ``rules``: ``using(TEXT_BIAS=..., TEXT_WEIGHTS=...)``.

    Faulty tables raise, and the old ones stand again.  One at a time: another thread's ``using`` waits, and plans that
    it builds outside of one would see these tables.
    """
    with _ONE:
        yield from _with_tables(tables)


def _with_tables(tables: dict) -> Iterator[None]:
    old, specs = {k: getattr(rules, k) for k in tables}, dict(base.SPECS)

    def put(values: dict) -> None:
        for k, v in values.items():
            setattr(rules, k, v)
        base.forget_columns()

    try:
        put(tables)
        if found := faults():
            raise ValueError("; ".join(found))
        base.SPECS.update(base.specs_of(rules.DETECTORS))
        yield
    finally:
        put(old)
        base.SPECS.clear()
        base.SPECS.update(specs)


def write_weights(bias: float, weights: dict[str, float], path: str) -> None:
    """Calibrated weights as JSON."""
    with open(path, "w") as f:
        json.dump({"bias": bias, "weights": weights}, f, indent=1, sort_keys=True)


def read_weights(path: str) -> dict:
    """What ``using`` takes."""
    with open(path) as f:
        found = json.load(f)
    return {"TEXT_BIAS": found["bias"], "TEXT_WEIGHTS": found["weights"]}
