"""Repeated and missing keys, blank texts, Markdown files, evidence on the row, other rule tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkscan import rules
from inkscan.operators import evaluate, findings, image, ngram, scoring
from inkscan.operators.catalog import catalog, read_weights, using, write_weights
from inkscan.plans import analyze
from inkscan.plans.context import with_context
from inkscan.sources import corpora, files
from inkscan.streaming.sessions import load_history
from tests.test_other import BODY, archive, png

TEXT = "It is crucial to delve into the vibrant tapestry of ideas — really — and it is not just fast, but it is careful. Plain words, apples, pears and plums follow here. " * 3


def test_blank_texts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["\n\t", "  ", None, "", "x", "y" * 100_001, "🚀" * 50_001])], "id int, text string")
    assert {r.id: r.status for r in analyze.rejected(df, ["id"]).collect()} == {0: "empty", 1: "empty", 2: "empty", 3: "empty", 5: "too_long", 6: "too_long"}


def test_repeated_keys(spark):
    rows = [(1, TEXT), (1, TEXT + "An other end."), (1, TEXT), (None, TEXT)]
    df = spark.createDataFrame(rows, "id int, text string")
    model = ngram.train(df, min_count=1)
    p = analyze.detect(df, ["id"], ["P-01"], model).collect()
    assert len(p) == 4 and all(r["P-01"].applicable for r in p)
    reports = analyze.analyze(df, ["id"], ["L-01", "T-03"], model)
    d = scoring.diff(reports, reports, "id").collect()
    assert len(d) == 4 and all(r.closed == [] and r.opened == [] and set(r.remaining) == {"L-01", "T-03"} for r in d)
    results = analyze.detect(df, ["id"], ["L-01"])
    heat = findings.heat(with_context(df), results, results.select("id", F.lit(50.0).alias("score")), "id").collect()
    assert len(heat) == sum(len(r.sents) for r in with_context(df).dropDuplicates(["id", "text"]).collect())


def test_a_large_model_meets_grams_in_a_join(spark, monkeypatch):
    df = spark.createDataFrame([(1, TEXT), (1, TEXT + "An other end."), (None, None)], "id int, text string")
    model = ngram.train(df, min_count=2)
    small = analyze.detect(df, ["id"], ["P-01"], model).collect()
    monkeypatch.setattr(ngram, "SENT_GRAMS", 0)
    large = analyze.detect(df, ["id"], ["P-01"], model).collect()
    assert sorted(round(r["P-01"].value, 9) for r in small) == sorted(round(r["P-01"].value, 9) for r in large) and len(small) == 3


def test_dedupe(spark):
    df = spark.createDataFrame([(5, "A"), (5, "B"), (3, "B"), (7, "C"), (7, "C"), (8, None), (None, "D")], "id int, text string")
    assert sorted(map(tuple, evaluate.dedupe_by_prefix(df, "id").collect()), key=repr) == [(3, "B"), (5, "A"), (7, "C"), (8, None), (None, "D")]
    some = spark.createDataFrame([(i, "en", "t" * 300 + str(i % 40) + "u" * (200 if i % 2 else 0)) for i in range(80)], "id int, lang string, text string")
    built = evaluate.build_dataset(some, ["lang"], "id", 3)
    assert built.count() <= 3 and set(built.columns) == {"id", "lang", "text", "is_test"}


def test_numbered_and_auc(spark):
    rng = np.random.default_rng(0)
    rows = [(int(c), float(s), bool(y)) for c, s, y in zip(rng.integers(0, 3, 900), rng.integers(0, 200, 900), rng.random(900) < 0.4, strict=True)] + [(None, 1.0, True), (None, None, False)]
    df = spark.createDataFrame(rows, "cell int, score double, y boolean").withColumn("id", F.monotonically_increasing_id())
    got = evaluate.numbered(df, ["cell"], ["score", "id"]).collect()
    for c in (0, 1, 2, None):
        mine = sorted((r for r in got if r.cell == c), key=lambda r: (r.score is not None, r.score or 0, r.id))
        assert [r._place for r in mine] == list(range(len(mine)))
    known = df.where("score is not null")
    p, n = (np.array([r.score for r in known.where(w).collect()]) for w in ("y", "not y"))
    want = ((p[:, None] > n).mean() + (p[:, None] == n).mean() / 2)
    assert evaluate.roc_auc(known, "score", "y").first().auc == pytest.approx(want)
    r = {(x.grouping, x.member): x for x in evaluate.held_out_report(known, "score", "y", ["cell"], 100).collect()}
    assert set(r) == {("cell", "0"), ("cell", "1"), ("cell", "2"), ("cell", None)} and sum(x.n for x in r.values()) == 901
    x, y = np.array([[0.0], [0.1], [0.9], [1.0]]), np.array([0.0, 0.0, 1.0, 1.0])
    assert (np.diff(evaluate.leave_one_out(x, y, epochs=300)) >= 0).all()


def test_evidence_on_the_row_as_by_joins(spark):
    ids = ["T-03", "L-01", "S-02", "S-06"]
    df = spark.createDataFrame([(1, TEXT), (2, "Nothing of note stands here. It is short."), (3, "важно отметить, что mixed text delves on " + "и мы идём дальше with it " * 4)], "id int, text string")
    r = {x.id: x for x in analyze.analyze(df, ["id"], ids, proofs=True).collect()}
    results = analyze.detect(df, ["id"], ids)
    spans = findings.finding_spans(results, ["id"], ids).collect()
    assert {i: sorted((f.detector, f.start, f.end) for f in r[i].findings) for i in r} == {i: sorted((f.detector, f.start, f.end) for f in spans if f.id == i) for i in r}
    heat = findings.heat(with_context(df), results, results.select("id", scoring.combine(ids).alias("score")), "id").collect()
    assert {i: [(s.start, s.end, s.heat) for s in r[i].sentences] for i in r} == {i: sorted((s.start, s.end, s.heat) for s in heat if s.id == i) for i in r}
    assert {f.label.lower() for f in r[3].findings} >= {"важно отметить", "delves"}
    hints = {a.rule: a.hints for a in r[1].advice}
    assert any(h.phrase == "crucial" for h in hints["L-01.markers"])
    shown = findings.highlights(analyze.analyze(df, ["id"], ids, proofs=True), ["id"], ["T-03"], 0.3).collect()
    assert {s.why for s in shown if s.id == 1} == {"T-03", "sentence"}


def test_files_to_reports(spark, tmp_path):
    page = BODY.replace("<w:t>Hello there</w:t>", "<w:br w:type='page'/><w:t>Hello there</w:t>", 1)
    made = {
        "a.docx": archive(word__document=page), "b.md": ("# Head\n\n**bold** text\n\n" + TEXT).encode(), "c.txt": ("**bold** text\r\n\r\n" + TEXT).encode(), "d.png": png(),
        "e.py": b"import os\nx = 1\n", "f.txt": b" \n\t", "g.rtf": rb"{\rtf1 rocket \u-10179?\u-8576? here}", "h.xyz": b"?",
    }
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    parsed = files.read_files(spark, str(tmp_path)).cache()
    p = {x.path.rpartition("/")[2]: x for x in parsed.collect()}
    assert [tuple(x) for x in p["a.docx"].places] == [(0, 11, 1, 2), (13, 24, 2, 2)] and p["g.rtf"].text == "rocket 🚀 here"
    assert [x.paragraph for x in p["b.md"].places] == [1, 2, 3] and all(p["b.md"].text[x.start : x.end].strip() for x in p["b.md"].places)
    r = {x.path.rpartition("/")[2]: x for x in analyze.analyze_files(parsed).collect()}
    assert {k: x.status for k, x in r.items() if x.score is None} == {"f.txt": "empty", "h.xyz": "unsupported"}
    assert {k: x.kind for k, x in r.items()} == {"a.docx": "document", "b.md": "document", "c.txt": "document", "d.png": "image", "e.py": "code", "f.txt": "document", "g.rtf": "document", "h.xyz": None}
    judged = {k: {m.detector for m in r[k].metrics} for k in ("b.md", "c.txt")}
    assert "T-05" in judged["c.txt"] and "T-05" not in judged["b.md"]  # marks are no fault of a Markdown file
    pasted = analyze.analyze_pasted(spark.createDataFrame([(1, "import os\nx = f(1)\nreturn x;"), (2, TEXT)], "id int, text string"), ["id"]).collect()
    assert {x.id: x.kind for x in pasted} == {1: "code", 2: "text"}


def test_heat_map(spark):
    rng = np.random.default_rng(0)
    half = np.dstack([rng.integers(0, 256, (128, 128, 3)), np.full((128, 128), 255)]).astype(np.uint8)
    half[:, :64] = 128
    df = spark.createDataFrame([(1, (128, 128, bytearray(half.tobytes()))), (2, (8, 8, bytearray(256)))], "id int, pixels struct<width:int,height:int,data:binary>")
    r = {x.id: x.h for x in df.select("id", image.heat_map().alias("h")).collect()}
    assert r[2] is None and np.array(r[1])[:, :7].min() == 1.0 and np.array(r[1])[:, 9:].max() == 0.0


def test_rule_sets(spark, tmp_path):
    df = spark.createDataFrame([(1, TEXT)], "id int, text string")
    before = analyze.analyze(df, ["id"], ["L-01"]).first().score
    write_weights(5.0, {"L-01": 1.0}, f"{tmp_path}/w.json")
    with using(**read_weights(f"{tmp_path}/w.json")):
        assert analyze.analyze(df, ["id"], ["L-01"]).first().score > before
    assert analyze.analyze(df, ["id"], ["L-01"]).first().score == before
    with pytest.raises(ValueError, match="weight of X-99"), using(TEXT_WEIGHTS={"X-99": 1.0}):
        pass
    assert rules.TEXT_WEIGHTS["L-01"] > 1 and catalog(spark).count() == len(rules.DETECTORS)
    model = ngram.train(df, min_count=1)
    ngram.write_model(*model, f"{tmp_path}/model")
    again = ngram.read_model(spark, f"{tmp_path}/model")
    assert again[1] == model[1] and sorted(again[0].collect()) == sorted(model[0].collect())


def test_corpora(spark, tmp_path):
    (tmp_path / "a.csv").write_text('text,label\n"one, ""two""\nlines",Human\nother,gpt\n')
    got = sorted((r.text, r.ai, r.model) for r in corpora.from_csv(spark, f"{tmp_path}/a.csv", "text", "label", "ru", "s").collect())
    assert got == [('one, "two"\nlines', False, "human"), ("other", True, "gpt")]
    spark.createDataFrame([("s", i) for i in range(30)], "session_id string, version long").write.parquet(f"{tmp_path}/h")
    assert sorted(r.version for r in load_history(spark, f"{tmp_path}/h").collect()) == list(range(10, 30))
