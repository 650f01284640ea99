"""Slow patterns are held against the parts of a text that may hold them, with the counts of the whole text."""

import random

from pyspark.sql import functions as F

from inkscan import rules
from inkscan.functions.regexlib import count, js, stretches
from inkscan.operators import lexical, structure

CONTRAST_EN = js(r"\b(?:(?:it'?s|this is|that'?s|is|are)\s+not\s+(?:just|only|merely|simply|about)\s[^.!?]{1,60}?[,;—–-]\s*(?:it'?s|but|this is|they'?re|it is)\s[\w-]+|not only\s[^.!?]{1,80}?\sbut also\s[\w-]+|isn'?t (?:just|only)\s[^.!?]{1,60}?[—–-]\s*it'?s\s[\w-]+)", "i")
TRIAD_EN = js(r"\b[\w-]++(?:\s[\w-]++)?+,\s[\w-]++(?:\s[\w-]++)?,?\s(?:and|or)\s[\w-]+(?:\s[\w-]+)?", "i")
PASSIVE_EN = js(r"\b(?:is|are|was|were|be|been|being)\s+(?:\w+ly\s+)?\w+(?:ed|en)\b", "i")
NUMBERS = js(r"\b(?:19|20)\d{2}\b|\b\d{1,2}[./]\d{1,2}(?:[./]\d{2,4})?\b")
PARTS = ["is not just", "it's", "not only", "but also", "isn't just", "isnt only", "—", "fast", "well-known", "-x", "ſolid", "K", "İs", "ıs", "é", "and", "or", "red", "was quickly taken", "is eaten", "K2", "19", "2020", "3/4", "12.05.1999"]
GAPS = [" ", " ", " ", ", ", ", ", ". ", "! ", "; ", "", "-", " ", "\n"]


def test_parts_of_texts_hold_all_matches(spark):
    rnd = random.Random(3)
    texts = ["It is not just fast, but it is careful. Red, green and blue.", "ſred, green and blue", "K-red, green and blue", ", a, b and c", "x. -a, b and c"]
    texts += ["".join(rnd.choice(PARTS) + rnd.choice(GAPS) for _ in range(60)) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    t = F.col("text")
    of = lambda within, pattern: count(stretches(t, *within), pattern)
    pairs = {
        "contrast": (of(structure.CONTRAST_WITHIN["en"], structure.CONTRAST["en"]), count(t, CONTRAST_EN)),
        "triad": (of(structure.TRIAD_WITHIN["en"], structure.TRIAD["en"]), count(t, TRIAD_EN)),
        "whole triad": (count(t, structure.TRIAD["en"]), count(t, TRIAD_EN)),
        "passive": (count(t, lexical.PASSIVE["en"]), count(t, PASSIVE_EN)),
        "numbers": (count(t, lexical.NUMBERS), count(t, NUMBERS)),
    }
    found = df.select(*(F.sum(F.when(a == b, 0).otherwise(1)).alias(f"{k}, other") for k, (a, b) in pairs.items()), *(F.sum(b).alias(k) for k, (_, b) in pairs.items())).first()
    for k in pairs:
        assert found[f"{k}, other"] == 0 and found[k] > 0, k


def test_texts_without_a_contrast_leave_nothing(spark):
    row = spark.range(1).select(stretches(F.lit("Plain words. It is not just this, but more! And so on."), *structure.CONTRAST_WITHIN["en"]).alias("a"), stretches(F.lit("It is not so."), *structure.CONTRAST_WITHIN["en"]).alias("b")).first()
    assert row == (" It is not just this, but more", "")


def test_markers_that_hold_a_full_stop_are_looked_for_in_whole_texts(monkeypatch):
    assert not lexical.crosses_sentences("en")
    monkeypatch.setitem(rules.MARKERS, "en", [*rules.MARKERS["en"], (r"e\.g\. so", 1.0, [])])
    assert lexical.crosses_sentences("en")
