"""Micro-cases of the context and the text detectors."""

from pyspark.sql import functions as F

from inkscan.functions.regexlib import cv, mean, per1000
from inkscan.operators import evaluate, ngram, scoring
from inkscan.operators.normalize import normalize_text
from inkscan.plans import analyze
from inkscan.plans.context import with_context


def contexts(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return {r.id: r for r in with_context(df).collect()}


def values(spark, ids, *texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return [r for r in analyze.detect(df, ["id"], ids, **how).orderBy("id").collect()]


def test_language_and_segments(spark):
    c = contexts(
        spark, "Привет, как дела?", "Hello there, friend", "", "Привет hello мир",
        "Это было в 2020 г. в Москве. Цена 3.5 руб. Ок! Правда? Да…", "# Title\n\nSome paragraph text here.\n\n- one\n- two\n\nLast one.",
        "a line\nsecond line\nthird line", "Don't stop-me now", None,
    )
    assert [c[i].lang for i in (0, 1, 2)] == ["ru", "en", "en"] and c[3].mixed_share > 0.2
    assert len(c[4].sents) == 5 and c[4].sents[1].text.startswith("Цена 3.5")
    assert [p.kind for p in c[5].paras] == ["heading", "text", "list", "list", "text"]
    assert len(c[6].paras) == 3 and c[7].words == ["don't", "stop-me", "now"] and c[8].n_words == 0


def test_numbers(spark):
    r = spark.range(1).select(
        mean(F.expr("cast(array() as array<double>)")).alias("a"), cv(F.array(F.lit(0.0), F.lit(0.0))).alias("b"), cv(F.array(F.lit(1.0), F.lit(3.0))).alias("c"),
        per1000(F.lit(5), F.lit(0)).alias("d"), per1000(F.lit(5), F.lit(500)).alias("e"),
    ).first()
    assert tuple(r) == (0, 0, 0.5, 0, 10)


def test_typography(spark):
    ids = ["T-01", "T-02", "T-03", "T-04", "T-05", "T-06"]
    r = values(
        spark, ids, "М\u006fсква п\u0061ртнёр т\u0065кст обычный", "s\u03bfund w\u03bfrd plain", "\ufeffa\u200bb c\u00add and longword\u00a0longer, for us\u00a0too",
        "word — " * 40, '"straight" and «angled» words - here — there', "**bold** text\n# head\n`code` [a](b)", "её ещё всё нём идёт это так", "ее еще все нем идет это так",
    )
    assert r[0]["T-01"].value == 3 and r[1]["T-01"].value == 2
    assert r[2]["T-02"].value == 3
    assert r[3]["T-03"].score == 1 and r[4]["T-04"].value == 2 and r[5]["T-05"].value >= 4
    assert r[6]["T-06"].value == 1 and r[7]["T-06"].value == 0 and not r[0]["T-06"].applicable


def test_rhythm_and_structure(spark):
    even = " ".join(["The cat sat on the mat today."] * 12)
    period = " ".join("Aa b c d word. Bb c d e word. " + "Cc " + "w " * 18 + "end." for _ in range(5))
    ids = ["R-01", "R-02", "R-03", "R-04", "R-05", "S-01", "S-03", "S-04", "S-06"]
    r = values(
        spark, ids, even, " ".join(f"The {w} thing goes on and on." for w in "abcdefgh"), "# Introduction\n\nShort start.\n\n- one thing here\n- two thing here\n- three thing here\n\n"
        + "Some words here and there. " * 12 + "\n\n# Conclusion\n\nIn conclusion, all is well.", "- **Term:** some text\n- **Word:** some text\n- **Name:** some text\nx", "It's not just fast, but it's also careful and kind to people who read and write here every day of the week and more words go on and on and on and so forth.", period,
    )
    assert r[0]["R-01"].score == 1 and r[0]["R-02"].score == 1 and not r[0]["R-03"].applicable
    assert r[1]["R-05"].score == 1
    assert r[2]["S-01"].score > 0.6 and r[2]["S-03"].value >= 1
    assert r[3]["S-04"].value == 1 and r[4]["S-06"].value == 0 and r[5]["R-04"].value > 0.3


def test_quirks(spark):
    r = values(spark, ["L-01", "L-04", "L-07", "B-01", "S-08"], "уникальный комплексный подход играет ключевую роль " * 6, "maybe mayor word word " * 12, "It is crucial to delve into a vibrant tapestry " * 4)
    assert r[0]["L-01"].value == 0  # inflected forms never match
    assert r[1]["L-04"].value > 0  # prefixes of hedges do
    assert r[2]["L-01"].score == 1 and not r[2]["L-07"].applicable and not r[2]["B-01"].applicable


def test_citations(spark):
    body = "\n\n".join(f"Paragraph {i} has many words so that it counts as one of the long ones in the text, which needs twenty five words at least here [{i}, p. 10-20]." for i in range(1, 9))
    text = body + "\n\n## References\n" + "\n".join(f"{i}. Author {i}. Title. 1999. 150 p." for i in range(1, 8)) + "\n"
    r = values(spark, ["B-01"], text, text.replace("[3, p. 10-20]", "[3, p. 300]"))
    assert r[0]["B-01"].value == 1.5 + 0.8 + 0.5 and r[1]["B-01"].value == 2.8 + 1


def test_every_detector_on_odd_texts(spark):
    texts = ["", "Да.", "Hi", " \n\n\t ", "🚀" * 50, "a\n" * 300, "x" * 5000, "1. 2. 3. " * 50, "𝔘𝔫𝔦 ‮퟿ " * 20]
    for row in values(spark, analyze.NATIVE_TEXT + ["P-02"], *texts):
        for d in analyze.NATIVE_TEXT + ["P-02"]:
            assert 0 <= row[d].score <= 1 and (row[d].applicable or row[d].score == 0)


def test_reports(spark):
    ai = "It is crucial to delve into the vibrant tapestry of ideas. Moreover, it's worth noting that the landscape is multifaceted. " * 8
    human = "Yeah, I went to Berlin yesterday (what a trip!) and lost my keys. Huh? My friend Anna said: don't worry... We found them in 2019! " * 8
    df = spark.createDataFrame([(1, ai), (2, human), (3, ""), (4, "x" * 100_001), (5, "short one")], "id int, text string")
    r = {x.id: x for x in analyze.analyze(df, ["id"]).collect()}
    assert sorted(r) == [1, 2, 5] and r[1].score > r[2].score and r[5].warnings == ["short_text"]
    assert {x.id: x.status for x in analyze.rejected(df, ["id"]).collect()} == {3: "empty", 4: "too_long"}
    assert any(a.rule == "L-01.markers" for a in r[1].advice) and all(a.effort in (1, 2, 3) for a in r[1].advice)
    assert [a.priority for a in r[1].advice] == sorted((a.priority for a in r[1].advice), reverse=True)
    d = scoring.diff(analyze.analyze(df.where("id = 1"), ["id"]), analyze.analyze(df.where("id = 2").withColumn("id", F.lit(1)), ["id"]), "id").first()
    assert "L-01" in d.closed and d.score_after < d.score_before


def test_verdict_and_combine(spark):
    assert [x[0] for x in spark.createDataFrame([(10.0,), (50.0,), (90.0,)], "s double").select(scoring.verdict(F.col("s"))).collect()] == ["human", "mixed", "ai"]


def test_metrics(spark):
    df = spark.createDataFrame([(0.9, True), (0.8, True), (0.2, False), (0.1, False)], "s double, y boolean")
    auc = lambda d: evaluate.roc_auc(d, "s", "y").first().auc
    assert auc(df) == 1 and auc(df.withColumn("s", F.lit(0.5))) == 0.5 and auc(df.where("y")) == 0.5
    m = evaluate.threshold_metrics(spark.createDataFrame([(1.0, True), (1.0, False), (0.0, True)], "s double, y boolean"), "s", "y", 0.5).first()
    assert m.fpr == 1 and m.f1 == 0.5


def test_normalise(spark):
    r = spark.createDataFrame([("pаypаl c​ode",), ("Мoсква",), ("αlpha",), ("plain",)], "t string").select(normalize_text(F.col("t")).alias("n")).collect()
    assert [x.n.text for x in r] == ["paypal code", "Москва", "alpha", "plain"] and [x.n.replaced for x in r] == [2, 1, 1, 0] and r[0].n.removed == 1


def test_ngram_model(spark):
    train = spark.createDataFrame([("the cat sat on the mat. the dog ran to the cat.",)] * 3, "text string")
    model, alphabet = ngram.train(train, min_count=2)
    probe = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "xylophone quartz jumbo")], "id int, text string")
    bits = {r.id: r.bits for r in ngram.cross_entropy(probe, ["id"], model, alphabet).collect()}
    assert bits[1] < bits[2]
    assert spark.createDataFrame([("Ёлка 123!",)], "t string").select(ngram.normalised_text(F.col("t"))).first()[0] == "елка 000!"


def test_data_sets(spark):
    df = spark.createDataFrame([(i, "en" if i % 2 else "ru", "same start" if i < 3 else f"other {i}") for i in range(20)], "id int, lang string, text string")
    assert evaluate.dedupe_by_prefix(df, "id").count() == 18
    assert evaluate.stratified_split(df, ["lang"], ["id"]).where("is_test").count() == 4
    assert evaluate.capped(df, ["lang"], ["id"], 3).count() == 6


def test_reports_hold_every_detector(spark):
    text = "".join(f"The {w} fox and its friend number {i} went over the hill to see what was there. " for i, w in enumerate("red old shy sad odd big wet fat new sly".split()))
    df = spark.createDataFrame([(1, text), (None, text), (3, "short one")], "id int, text string")
    model = ngram.train(df, min_count=1)
    r = {x.id: x for x in analyze.analyze(df, ["id"]).collect()}
    assert set(r) == {1, None, 3}
    assert "stats" in {c.category for c in r[1].categories} and "P-02" in {m.detector for m in r[1].metrics}
    found = {x.id: x for x in analyze.detect(df, ["id"], ["P-01", "P-02"], model).collect()}
    assert found[1]["P-01"].applicable and found[1]["P-01"] == found[None]["P-01"] and not found[3]["P-01"].applicable
