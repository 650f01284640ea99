"""Phrase index, sweep of heat, distributed fit, sessions that end, templates and edits, grouping sets, JSON arrays, the live registry, growing models."""

import json
import random
import re
import time
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkscan import rules
from inkscan.functions import regexlib
from inkscan.operators import base, edits, evaluate, findings, lexical, logistic, ngram, scoring
from inkscan.plans import analyze
from inkscan.plans.context import sentence_places, with_context
from inkscan.sources import json_array
from inkscan.streaming.sessions import recheck_stream

SF = "/root/testdata/sf0.01"
MARKED = "It is crucial to delve into the vibrant tapestry of ideas — in conclusion, it's worth noting a myriad of robust things. DELVES! Важно отметить, что в целом ключевых аспектов нет; следует учитывать уникальность. "


def test_trie_is_the_longest_phrase():
    draw = random.Random(2)
    for _ in range(50):
        listed = list({"".join(draw.choices("ab c", k=draw.randint(1, 5))) for _ in range(draw.randint(1, 9))})
        plain = re.compile("|".join(re.escape(p) for p in sorted(listed, key=lambda p: -len(p))))
        tree = re.compile(regexlib.trie(listed))
        text = "".join(draw.choices("ab c", k=200))
        assert [m.span() for m in tree.finditer(text)] == [m.span() for m in plain.finditer(text)], listed


def test_heads_begin_every_match():
    for lang in ("ru", "en"):
        for pattern, _, _ in rules.MARKERS[lang]:
            heads = regexlib.literal_heads(pattern)
            assert heads and all(heads), pattern
    assert regexlib.literal_heads("it'?s (?:a|b)") == ["it"] and regexlib.literal_heads("(?:a|bc) d") == ["a", "bc"]
    assert regexlib.literal_heads("a myriad of|myriad") == ["a myriad of", "myriad"]


@pytest.mark.parametrize("lang", ["ru", "en"])
def test_index_finds_what_scans_find(spark, lang):
    texts = [MARKED, MARKED.upper(), "nothing of note", "", "in conclusion" + MARKED, "landscape" * 3, "a myriad of myriad, in today's digital world; важно  отметить. погрузимся в эпоху цифровых"]
    df = with_context(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string"))
    scans = sum((regexlib.count(F.col("text"), lexical.marker_pattern(p)) * w for p, w, _ in rules.MARKERS[lang]), F.lit(0.0))
    rows = df.select(F.round(lexical.marker_weight(lang), 6).alias("a"), F.round(scans, 6).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and max(r.a for r in rows) > 3


def heat_by_pairs(sentences, spans):
    return sorted((k, s, e, int((min(1, o / 100 * 0.15 + sum(w for k2, a, b, w in spans if k2 == k and a < e and b > s) * 0.12 * 0.6)) * 100 + 0.5 + 1e-9) / 100) for k, s, e, o in sentences)


def test_sweep_is_every_pair(spark, monkeypatch):
    draw = random.Random(4)
    sentences = list({(k, s, s + draw.randint(1, 30), 51.3) for k in (1, 2) for s in draw.sample(range(400), 40)})
    spans = [(k, s, s + draw.randint(0, 60), draw.choice([0.3, 1.0, 2.5])) for k in (1, 1, 2) for s in draw.sample(range(400), 60)]
    want = heat_by_pairs(sentences, spans)
    frames = spark.createDataFrame(sentences, "k int, start int, end int, overall double"), spark.createDataFrame(spans, "k int, start int, end int, weight double")
    for block in (7, 1 << 16):
        monkeypatch.setattr(scoring, "SWEEP_BLOCK", block)
        assert sorted(map(tuple, scoring.sentence_heat(*frames, "k").collect())) == want
    row = spark.createDataFrame([([(s, e) for k, s, e, _ in sorted(sentences) if k == 1], [(s, e, w) for k, s, e, w in spans if k == 1])], "p array<struct<start:int,end:int>>, f array<struct<start:int,end:int,w:double>>")
    units = F.transform("f", lambda f: f.withField("w", scoring.as_units(f["w"])))
    got = row.select(F.explode(findings.heated(F.col("p"), units, F.lit(51.3))).alias("h")).select("h.*").collect()
    assert sorted((1, *r) for r in got) == [w for w in want if w[0] == 1]


def test_sweep_of_a_long_text(spark):
    n = 100_000
    sentences = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 5).cast("int").alias("start"), (F.col("id") * 5 + 5).cast("int").alias("end"), F.lit(10.0).alias("overall"))
    spans = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 5 + 1).cast("int").alias("start"), (F.col("id") * 5 + 12).cast("int").alias("end"), F.lit(1.0).alias("weight"))
    began = time.time()
    assert scoring.sentence_heat(sentences, spans, "k").agg(F.round(F.sum("heat"), 2)).first()[0] == pytest.approx((n - 2) * 0.23 + 0.09 + 0.16, abs=0.01)
    assert time.time() - began < 60


def test_places_of_sentences(spark):
    draw = random.Random(8)
    parts = ["One two.", " ", "\n", "\n\n", "Three!? ", "- item\n", "# Head\n", "…", "e.g. this", "3.5 ", " \t", "«Да…» ", "🚀 go. ", "\n \n"]
    texts = ["", " ", "One.", "  One.  Two. \n\n - a\n- b. c\n"] + ["".join(draw.choices(parts, k=draw.randint(1, 25))) for _ in range(120)]
    df = with_context(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string"))
    for r in df.select("text", F.transform("sents", lambda s: s["text"]).alias("s"), sentence_places(F.col("text")).alias("p")).collect():
        assert [r.text[p.start : p.end] for p in r.p] == r.s
        assert all(a.end <= b.start for a, b in zip(r.p, r.p[1:], strict=False))


def labelled(n=400, d=3, seed=1):
    draw = np.random.default_rng(seed)
    x = draw.random((n, d))
    y = (draw.random(n) < 1 / (1 + np.exp(-(x @ np.array([3.0, -2.0, 1.0][:d]) - 1)))).astype(float)
    return x, y


def test_fit_is_the_bounded_minimum(spark):
    x, y = labelled()
    rows = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "a double, b double, c double, y double")
    features = [F.col(c) for c in "abc"]
    for parts in (1, 5):
        fit = logistic.fit(logistic.feature_rows(rows.repartition(parts), features, F.col("y")), 0.05)
        b, w = evaluate.fit_logistic(x, y, None, 0.05, 1.0, 20_000)
        assert abs(fit.bias - b) < 1e-6 and np.abs(fit.weights - w).max() < 1e-6 and fit.passes < 30
        assert fit.weights[1] == 0 and fit.slope[2] > 0 and np.abs(fit.slope[fit.free]).max() < 1e-9
    weighted = logistic.fit(logistic.feature_rows(rows.withColumn("w", F.when(F.col("a") > 0.5, 3.0).otherwise(1.0)), features, F.col("y"), F.col("w")), 0.05)
    twice = rows.where("a > 0.5")
    again = logistic.fit(logistic.feature_rows(rows.unionByName(twice).unionByName(twice), features, F.col("y")), 0.05)
    assert abs(weighted.bias - again.bias) < 1e-7 and np.abs(weighted.weights - again.weights).max() < 1e-7


def test_fit_edges(spark):
    empty = spark.createDataFrame([], "a double, y double")
    assert logistic.fit(logistic.feature_rows(empty, [F.col("a")], F.col("y"))).bias == 0
    rows = spark.createDataFrame([(1.0, 1.0), (None, 1.0), (2.0, None)], "a double, y double")
    one = logistic.fit(logistic.feature_rows(rows, [F.col("a")], F.col("y")))
    assert np.isfinite(one.bias) and one.bias > 5 and one.total == 2


def test_leave_one_out_is_as_refits(spark):
    x, y = labelled(150)
    rows = spark.createDataFrame([(i, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "i int, a double, b double, c double, y double")
    features = [F.col(c) for c in "abc"]
    fit = logistic.fit(logistic.feature_rows(rows, features, F.col("y")), 0.05)
    got = {r.i: r.score_without for r in logistic.leave_one_out(rows, fit, features, F.col("y")).collect()}
    for i in range(0, 150, 10):
        rest = np.arange(150) != i
        b, w = evaluate.fit_logistic(x[rest], y[rest], None, 0.05, 1.0, 6000)
        assert abs(100 / (1 + np.exp(-(b + x[i] @ w))) - got[i]) < 0.1


def test_fill(spark):
    df = spark.createDataFrame([(0.256, 3.0, "x", None, 2.5)], "a double, b double, s string, n double, h double")
    numbers, words = {"a": F.col("a"), "b": F.col("b"), "n": F.col("n"), "h": F.col("h")}, {"s": F.col("s"), "e": F.lit("")}
    cases = {
        "{a:.1f} of {a:.0%}": "0.3 of 26%", "{a} {b} {b:.2f}": "0.26 3 3.00", "{h:.0f}|{h:.1%}": "3|250.0%", "no place": "no place", "{missing} a  {n} b": "a b",
        "«{e}» и “{e}” {s}": "… и … x", " {s}{s} ": "xx", "{a:.1f": "{a:.1f", "{s:.1f}": "x",
    }
    got = df.select(*(edits.fill(t, numbers, words).alias(str(i)) for i, t in enumerate(cases))).first()
    assert list(got) == list(cases.values())


def test_advice_in_words(spark):
    df = spark.createDataFrame([(1, MARKED[:120] * 6)], "id int, text string")
    reports = analyze.analyze(df, ["id"], ["L-01", "T-03", "R-01", "R-02"])
    for lang, word in (("en", "Stock phrases"), ("ru", "Штампы")):
        advice = {a.rule: a for a in edits.in_words(reports, lang).first().advice}
        assert advice["L-01.markers"].title == word and re.search(r"\d+\.\d", advice["L-01.markers"].explain) and advice["L-01.markers"].actions
    own = edits.in_words(reports, "en", {"L-01.markers": {"en": ("{metric} {lo} {nothing}", "{gain:.1f}", ())}}).first().advice
    assert next(a for a in own if a.rule == "L-01.markers").title == "marker_density 0"


def test_edits_are_carried_out(spark):
    text = "Crucial things: it's worth noting that we DELVE into this; plays a crucial role. cаt a​b 🚀 robust"
    rows = [(1, text), (2, "nothing here"), (3, None), (4, "")]
    got = {r.id: r.fixed for r in edits.with_fixes(spark.createDataFrame(rows, "id int, text string")).collect()}
    assert got[1].text == "Important things:  that we Look at into this; matters a lot for. cat ab 🚀 solid" and (got[1].n_phrases, got[1].replaced, got[1].removed) == (5, 1, 1)
    assert got[2].text == "nothing here" and got[3].text == got[4].text == "" and got[2].n_phrases == 0
    before, after = (analyze.analyze(spark.createDataFrame([(1, t)], "id int, text string"), ["id"], ["L-01", "T-01", "T-02"]).first().score for t in (text * 9, (got[1].text + " ") * 9))
    assert after < before


def test_edits_that_overlap(spark):
    spans = [(0, 4, "A"), (2, 6, "B"), (5, 7, "C"), (8, 9, ""), (9, 12, "dd")]
    column = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(c).alias("label")) for a, b, c in spans))
    got = spark.createDataFrame([("abcdefghijklmnop",)], "text string").select(edits.applied(F.col("text"), column).alias("r")).first().r
    assert tuple(got) == ("Aefghddmnop", 3)


def test_reports_by_grouping_sets(spark):
    draw = random.Random(6)
    rows = [(draw.choice(["en", "de", None]), draw.choice("xy"), draw.choice([10.0, 65.0, 80.0, None]), draw.random() < 0.5) for _ in range(300)]
    rows = [(a, b, s or 1.0, y) for a, b, s, y in rows]
    df = spark.createDataFrame(rows, "lang string, family string, score double, y boolean")
    got = {(r.grouping, r.member): r for r in evaluate.held_out_report(df, "score", "y", ["lang", "family", ("lang", "family")]).collect()}
    assert len(got) == 3 + 2 + 6
    for (grouping, member), r in got.items():
        own = [x for x in rows if {"lang": x[0], "family": x[1], "lang/family": f"{x[0] or '-'}/{x[1]}"}[grouping] == member]
        pos, neg = [s for *_, s, y in own if y], [s for *_, s, y in own if not y]
        auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
        assert r.n == len(own) and r.auc == pytest.approx(auc) and r.fpr == pytest.approx(sum(s >= 65 for s in neg) / len(neg)) and r.tpr == pytest.approx(sum(s >= 65 for s in pos) / len(pos))


def test_json_array_of_many_ranges(spark, tmp_path):
    draw = random.Random(3)
    odd = ['a "quoted" {brace} [x], y', "back\\slash\\", "é🚀", "}{][,\"", "", "line\nend", "\\\"", None, "x" * 300]
    rows = [{"id": i, "text": draw.choice(odd), "list": [draw.choice(odd), {"k": [i, [i]]}], "more": {"a": {"b": draw.choice(odd)}}} for i in range(400)]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.json").write_text("﻿ \n" + json.dumps(rows, ensure_ascii=False, indent=1) + "\n")
    (tmp_path / "a" / "two.json").write_text(json.dumps([1, "two, 3", None, [4, {"x": "]"}], {}], separators=(",", ":")))
    (tmp_path / "a" / "none.json").write_text(" [ \n ] ")
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
        for size in ("137", "1000", "100000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            found = json_array.elements(spark, f"{tmp_path}/a").collect()
            by_file = {}
            for r in sorted(found, key=lambda r: (r.file, r.block, r.place)):
                by_file.setdefault(r.file.rsplit("/", 1)[1], []).append(json.loads(r.value))
            assert by_file == {"one.json": rows, "two.json": [1, "two, 3", None, [4, {"x": "]"}], {}]}, size
        table = json_array.read_json_array(spark, f"{tmp_path}/a/one.json", "id long, text string, other int")
        assert sorted((r.id, r.text) for r in table.collect()) == [(r["id"], r["text"]) for r in rows] and table.where("other is not null").count() == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_live_registry(spark):
    df = spark.createDataFrame([(1, "Plain words, apples and pears; more words follow here. " * 9)], "id int, text string")
    spec = ("X-01", "style", "text", 1.0, "semicolons", "up", 0.0, 1.0, 0.0, 1.0, (0.0, 0.2), (0.0, 0.2))
    before = analyze.analyze(df, ["id"]).first()

    @base.register("X-01", spec, [("X-01.semicolons", 1, 4.0, False)])
    def semicolons():
        return base.result("X-01", regexlib.count(F.col("text"), ";"))

    try:
        with_it = analyze.analyze(df, ["id"]).first()
        assert "X-01.semicolons" in [a.rule for a in with_it.advice] and "X-01" in [m.detector for m in with_it.metrics] and with_it.score > before.score
        assert "X-01" in [d for c in with_it.categories for d in c.detectors]
    finally:
        base.unregister("X-01")
    assert analyze.analyze(df, ["id"]).first() == before
    with pytest.raises(ValueError):
        base.register("Y-99")(semicolons)


def test_growing_model(spark, tmp_path):
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(200)
    texts = spark.createDataFrame(texts.collect(), "text string")
    half = texts.withColumn("n", F.xxhash64("text") % 2 == 0)
    whole, size = ngram.train(texts, min_count=3)
    grown = ngram.GrowingModel(spark, f"{tmp_path}/counts")
    for i, part in enumerate((half.where("n"), half.where("not n"), half.where("not n"))):
        grown.add(part, min(i, 1))  # the last batch comes twice, under one name
    for model, alphabet in (grown.model(3), grown.compact(f"{tmp_path}/sum").model(3)):
        assert alphabet == size and sorted(map(tuple, model.collect())) == sorted(map(tuple, whole.collect()))
    half.select("text").where("n").write.parquet(f"{tmp_path}/in")
    stream = ngram.GrowingModel(spark, f"{tmp_path}/streamed")
    stream.grow(spark.readStream.schema("text string").parquet(f"{tmp_path}/in"), f"{tmp_path}/cp", once=True).awaitTermination()
    half.select("text").where("not n").write.mode("append").parquet(f"{tmp_path}/in")
    stream.grow(spark.readStream.schema("text string").parquet(f"{tmp_path}/in"), f"{tmp_path}/cp", once=True).awaitTermination()
    assert sorted(map(tuple, stream.model(3)[0].collect())) == sorted(map(tuple, whole.collect()))


def test_sessions_late_rows_and_expiry(spark, tmp_path):
    marked = "It is crucial to delve into the vibrant tapestry of robust realms. " * 10
    plain = "I went home yesterday. Huh! My dog (a big one) ate it... Why? Nobody knows, honestly, we tried. " * 10
    at = lambda h, m=0: datetime(2024, 5, 1, h, m)
    (tmp_path / "in").mkdir()
    schema = "session_id string, at timestamp, fresh boolean, text string"
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").json(f"{tmp_path}/in")
    query = recheck_stream(stream, "1 hour", "1 hour").writeStream.format("memory").queryName("late_versions").option("checkpointLocation", f"{tmp_path}/cp").start()
    batches = [
        [("s", at(10), True, marked), ("t", at(10), True, plain)],
        [("s", at(10, 30), False, plain)],
        [("s", at(10, 10), False, plain), ("t", at(9, 50), False, marked)],  # late, but not too late
        [("u", at(14), True, plain)],  # the watermark is at 13:00: s and t end
        [("s", at(10, 40), False, marked), ("u", at(14, 1), False, marked)],  # the first is too late
        [("s", at(14, 10), False, marked)],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{tmp_path}/in/{i}")
        query.processAllAvailable()
    query.stop()
    rows = {(r.session_id, r.at.replace(tzinfo=None)): r for r in spark.table("late_versions").collect()}
    assert len(rows) == 8 and ("s", at(10, 40)) not in rows
    assert rows["s", at(10, 30)].version == 2 and rows["s", at(10, 30)].score_before == rows["s", at(10)].score and "L-01" in rows["s", at(10, 30)].closed.split(",")
    # a late version is held against the one before it in time, and is not the newest
    assert rows["s", at(10, 10)].version == 3 and rows["s", at(10, 10)].score_before == rows["s", at(10)].score
    assert rows["t", at(9, 50)].score_before is None and rows["t", at(9, 50)].closed == ""
    # an ended session begins anew
    assert rows["s", at(14, 10)].version == 1 and rows["s", at(14, 10)].score_before is None
    assert rows["u", at(14, 1)].version == 2 and "L-01" in rows["u", at(14, 1)].opened.split(",")


def test_reports_unnest(spark):
    """Advice, categories and metrics as rows, and filters on what was computed, cost no more than the reports."""
    df = spark.createDataFrame([(i, MARKED * 3 + "plain " * i) for i in range(3)], "id int, text string")
    reports = analyze.analyze(df, ["id"])
    whole = {r.id: r for r in reports.collect()}
    began = time.time()
    advice = reports.select("id", F.explode("advice").alias("a")).select("id", "a.rule", "a.detectors", "a.gain").where("gain > 0").collect()
    assert sorted((r.id, r.rule) for r in advice) == sorted((i, a.rule) for i, r in whole.items() for a in r.advice if a.gain > 0)
    assert reports.where("score > 0").select(F.explode("metrics").alias("m")).select("m.detector").count() == sum(len(r.metrics) for r in whole.values())
    assert time.time() - began < 60
    began = time.time()
    analyze.analyze(df, ["id"])  # its columns are built by now
    assert time.time() - began < 20
