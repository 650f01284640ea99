"""Findings, heat, calibration, corpora, registry."""

import gzip
import json

import numpy as np
from pyspark.sql import functions as F

from inkscan.operators import evaluate, findings, scoring
from inkscan.operators.base import REGISTRY, register, result, unregister
from inkscan.operators.calibrate import calibrate
from inkscan.plans import analyze
from inkscan.plans.context import with_context
from inkscan.sources import corpora


def test_findings_and_heat(spark):
    text = "A plain sentence stands here. It is crucial to delve into the vibrant realm of robust ideas. Another plain one follows it."
    df = spark.createDataFrame([(1, text)], "id int, text string")
    results = analyze.detect(df, ["id"], ["L-01"])
    spans = findings.finding_spans(results, ["id"]).collect()
    assert {text[s.start : s.end].lower() for s in spans} == {"crucial", "delve", "vibrant", "realm", "robust"} and all(s.score == 1 for s in spans)
    heat = findings.heat(with_context(df), results, results.select("id", F.lit(80.0).alias("score")), "id").orderBy("start").collect()
    assert [text[h.start : h.end] for h in heat] == [s + "." for s in text.rstrip(".").split(". ")]
    assert heat[1].heat == 0.12 + 0.0 + round(0.6 * 0.12 * 2.5 * 5, 2) or heat[1].heat > heat[0].heat == heat[2].heat == 0.12
    hints = df.select(findings.marker_hints(F.col("text")).alias("h")).first().h
    assert {h.phrase: h.options for h in hints}["crucial"] == ["important", "big", "remove"]


def test_calibration(spark):
    rows = [(i, i % 2 == 0, (0.0, True, 0.9 if i % 2 == 0 else 0.1), (0.0, True, 0.5)) for i in range(100)]
    kind = "struct<value:double,applicable:boolean,score:double>"
    df = spark.createDataFrame(rows, f"id int, y boolean, `R-01` {kind}, `R-02` {kind}")
    bias, w = calibrate(df, "y", ["R-01", "R-02"])
    assert w["R-01"] > 1 and w["R-02"] >= 0 and 1 / (1 + np.exp(-(bias + 0.1 * w["R-01"] + 0.5 * w["R-02"]))) < 0.66
    assert evaluate.clamp_bias(5.0, np.array([0.0] * 19 + [3.0])) <= np.log(65 / 35)


def test_corpora(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one text\n===\n\n two\nlines \n===\n  \n")
    assert sorted(r.text for r in corpora.split_texts(spark, str(tmp_path / "a.txt")).collect()) == ["one text", "two\nlines"]
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write(json.dumps({"lang": "en", "ai": True, "text": "t"}) + "\n")
    row = corpora.samples(spark, str(tmp_path / "b.jsonl.gz")).first()
    assert row.ai and row.model is None
    corpora.write_reports(spark.range(2), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).columns == ["generatedAt", "id"]


def test_registry_and_versions(spark):
    before = REGISTRY["T-03"]
    register("T-03")(lambda: result("T-03", F.lit(9)))
    try:
        assert analyze.detect(spark.createDataFrame([("x",)], "text string"), ["text"], ["T-03"]).first()["T-03"].score == 1
    finally:
        register("T-03")(before)
    unregister("none of these")
    versions = spark.createDataFrame([("s", i) for i in range(30)], "s string, v int")
    assert sorted(r.v for r in scoring.keep_last(versions, "s", "v").collect()) == list(range(10, 30))
