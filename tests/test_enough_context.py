"""A detector computes no more of the text context than it reads, and that once."""

import random

from pyspark.sql import functions as F

from inkscan.functions.regexlib import WORD, WS
from inkscan.operators import academic
from inkscan.plans import analyze
from inkscan.plans.context import ABBREVIATIONS, MARK, SENTENCE_END, kind_of, paragraphs_of


def plan(spark, detector):
    df = spark.createDataFrame([(1, "a")], "doc_id int, text string")
    return analyze.detect(df, ["doc_id"], [detector]).select("doc_id", f"`{detector}`.*")._jdf.queryExecution().optimizedPlan().toString()


def rows(seed):
    rnd = random.Random(seed)
    parts = ["Thus it goes", "e.g. a", "Dr. smith", "J. Doe", "J. doe", "5. 6", "т. е. это", "…", "?!", "»", "”", "# Head", "#", "## a b", "- item", "12) item", "©  c", "😀 smile", "😀" * 80, "😀" * 81, "é" * 80, "a" * 80, "a" * 81, "İ", "one two three"]
    gaps = [" ", " ", ". ", "! ", "", "\n", "\n\n", "\n \r\n", "　", "﻿", "\u0085"]
    texts = ["", "\n", "\n\n", " \n \n ", "a\n\n", "\n\na"] + ["".join(rnd.choice(parts) + rnd.choice(gaps) for _ in range(rnd.choice([1, 3, 20]))) for _ in range(600)]
    return [(t,) for t in texts]


def test_s05_reads_sentences_without_counting_words(spark):
    """Words are looked for in a heading and in the first and the last sentence of a block, each time once."""
    assert plan(spark, "S-05").count(WORD) == 3 and plan(spark, "S-05").count(MARK) > 0


def test_blocks_are_as_by_patterns(spark):
    t = F.col("text")
    by_pattern = t.rlike(rf"\n[{WS}]*\n")
    found = spark.createDataFrame(rows(5), "text string").select(by_pattern.alias("blank"), (paragraphs_of(t) == paragraphs_of(t, by_pattern)).alias("same"), F.transform(paragraphs_of(t), kind_of).alias("kinds")).collect()
    assert all(r.same for r in found) and {r.blank for r in found} == {True, False} and {k for r in found for k in r.kinds} == {"text", "heading", "list"}
    long = spark.createDataFrame([("😀" * 80 + "x",), ("é" * 80,), ("é" * 81,), ("😀" * 79,), ("# " + "é" * 900,), ("x" * 400,), ("1" * 400 + ". item",), ("© c",)], "text string")
    assert [r.k for r in long.select(kind_of(t).alias("k")).collect()] == ["text", "heading", "text", "heading", "heading", "text", "list", "list"]


def test_s03_cuts_no_sentences(spark):
    for detector in ("S-03", "S-04", "S-07"):
        assert MARK not in plan(spark, detector), detector


def test_r02_looks_for_the_words_of_a_sentence_once(spark):
    """And in a heading; a sentence's first word is one of them."""
    assert plan(spark, "R-02").count(WORD) == 2


def test_sentences_end_as_by_what_comes_before(spark):
    before = (
        rf"(?=[.!?…])(?!(?<=(?<!\p{{L}})(?iu:{'|'.join(sorted(ABBREVIATIONS, key=lambda a: -len(a)))}|\p{{L}}))\.[{WS}]+[\p{{Ll}}\d])"
        rf"(?!(?<=\d)\.[{WS}]+\d)"
        rf"[.!?…]+[\"»”’)]*(?=[{WS}]|\z)"
    )
    marked = lambda pattern: F.regexp_replace("text", pattern, "$0" + MARK)
    found = spark.createDataFrame(rows(7), "text string").select(marked(before).alias("a"), marked(SENTENCE_END).alias("b")).collect()
    assert all(r.a == r.b for r in found) and sum(r.a.count(MARK) for r in found) > 1000


def test_l07_counts_attributions_once(spark):
    text = plan(spark, "L-07")
    assert [text.count(academic.ATTRIBUTION[lang]) for lang in ("ru", "en")] == [1, 1]


def test_l07_needs_attributions_or_references(spark):
    words, said, cited = "word " * 300, " Smith argued it." * 4, " [1] [2] [3]"
    texts = [words, words + said, words + cited, said + cited, words + " Smith argued it." * 3 + " [1] [2]"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = analyze.detect(df, ["doc_id"], ["L-07"]).orderBy("doc_id").select("`L-07`.*").collect()
    assert [r.applicable for r in found] == [False, True, True, False, False] and found[1].value == 6000 / 312 and found[2].value == 0
