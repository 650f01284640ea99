"""Heat of reports on the row, and markers in the parts of a text that hold some."""

from pyspark.sql import functions as F

from inkscan.operators import findings
from inkscan.operators.lexical import any_marker
from inkscan.plans import analyze
from inkscan.plans.context import with_context


def test_heat_of_results_moves_no_text_and_counts_as_by_tables(spark):
    said = "Plain words stand here. We delve into it — and İt's worth noting! More follows; a crucial, red, green and blue one. End."
    rows = [(1, said * 3), (1, said * 3), (1, "Short. " + said), (None, said), (2, "Nothing."), (3, "")]
    ids = ["T-03", "L-01", "S-02", "S-06"]
    df = spark.createDataFrame(rows, "id long, text string")
    results = analyze.detect(df, ["id"], ids).withColumn("overall", F.lit(50.0))
    found = findings.heat_of_results(results, "id")
    assert "text" not in found._jdf.queryExecution().optimizedPlan().toString()
    by_tables = findings.heat(with_context(df), results, results.select("id", F.col("overall").alias("score")), "id")
    got = sorted(map(tuple, found.collect()), key=repr)
    assert got == sorted(map(tuple, by_tables.collect()), key=repr) and len({r[3] for r in got}) > 1


def test_markers_in_parts_have_places_of_the_text(spark):
    text = "One. Two! İt's worth noting? Three; we delve. PIVOTAL, delved."
    df = with_context(spark.createDataFrame([(text,)], "text string"))
    spans = df.select(findings.SPANS["L-01"]().alias("s")).first().s
    assert [text[s.start : s.end] for s in spans] == ["İt's worth noting", "delve", "PIVOTAL", "delved"]
    assert df.select(F.col("text").rlike(any_marker("en")), F.lit("we develop").rlike(any_marker("en"))).first()[:] == (True, False)
