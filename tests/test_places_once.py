"""Places of sentences cut a text once."""

from pyspark.sql import functions as F

from inkscan.plans.context import sentence_places


def test_sentences_are_cut_once(spark):
    plan = str(spark.range(1).select(sentence_places(F.lit("a"))).columns[0])
    assert plan.count("regexp_replace") == 1
