"""P-02: how well a text compresses.  (P-01 needs a model: see ``ngram``.)"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from inkscan.functions.regexlib import WS
from inkscan.operators.base import register, result


@F.pandas_udf(DoubleType())
def deflated_share(texts: pd.Series) -> pd.Series:
    def share(text: str | None) -> float | None:
        raw = (text or "").encode()
        if not raw:
            return None
        packer = zlib.compressobj(9, zlib.DEFLATED, -15)
        return (len(packer.compress(raw)) + len(packer.flush())) / len(raw)

    return texts.map(share)


@register("P-02")
def compressible() -> Column:
    head = F.regexp_replace(F.substring("text", 1, 3000), f"[{WS}]+", " ")
    return result("P-02", deflated_share(head), F.length("text") >= 600)
