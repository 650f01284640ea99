import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkscan.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict(docs, langid.train(docs)).join(docs, "doc_id").where("held_out").agg(F.count("*").alias("n"), F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("right")).first()
    print(got)
    assert got.n > 100 and got.right > 0.97


def test_edges(spark):
    train = spark.createDataFrame([(0, "the cat and the dog the", "en"), (1, "der hund und der mann der", "de"), (4, None, "fr"), (5, "x", None)], "doc_id long, text string, lang string")
    model = langid.train(train)
    assert model.langs and None not in model.langs
    rows = [(10, None), (11, ""), (12, "12 !?"), (13, "the the"), (13, "the the"), (None, "der"), (14, "9" * 100_000), (15, "the " * 50_000), (16, "zzzz qqqq")]
    df = spark.createDataFrame([(*r, "de") for r in rows], "doc_id long, text string, held_out string")
    got = langid.predict(df, model).collect()
    assert len(got) == len(rows)
    assert [r.lang_pred for r in got if r.doc_id in (10, 11, 12, 14)] == ["und"] * 4
    assert all(r.lang_pred in model.langs for r in got if r.doc_id in (13, 15, 16, None))
    assert all(0 <= r.score <= 1 for r in got) and not any(r.held_out is None for r in got)
    nothing = langid.train(train.where("false"))
    assert {r.lang_pred for r in langid.predict(df, nothing).collect()} == {"und"}


def brute(docs):
    """Word-first backoff with dictionaries."""
    words_of = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    counts = {n: {} for n in range(5)}
    for i, text, lang in docs:
        if zlib.crc32(str(i).encode()) % 4 != 2 and lang is not None and text is not None:
            for w in words_of(text):
                for n in range(5):
                    for g in [w] if n == 0 else [w[k : k + n] for k in range(len(w) - n + 1)]:
                        counts[n].setdefault(lang, Counter())[g] += 1
    langs = sorted(counts[0])
    known = {n: set().union(*map(set, counts[n].values())) for n in counts}
    size = {n: {x: sum(counts[n].get(x, {}).values()) for x in langs} for n in counts}
    score = lambda n, x, g: math.log((counts[n].get(x, {}).get(g, 0) + 0.5) / (size[n][x] + 0.5 * max(1, len(known[n]))))
    total = sum(size[0][x] + 1 for x in langs)
    out = {}
    for i, text, _ in docs:
        words = words_of(text)
        if not words:
            out[i] = ("und", 0.0)
            continue
        z = {x: math.log((size[0][x] + 1) / total) for x in langs}
        for w in words:
            grams = []
            for k in range(len(w)):
                n = next((n for n in (4, 3, 2, 1) if k + n <= len(w) and w[k : k + n] in known[n]), None)
                grams += [(n, w[k : k + n])] if n else []
            for x in langs:
                z[x] += 2 * score(0, x, w) if w in known[0] else sum(score(n, x, g) for n, g in grams) / len(w)
        top = max(z.values())
        out[i] = (min(x for x in langs if z[x] == top), 1 / sum(math.exp(v - top) for v in z.values()))
    return out


def test_as_brute_force(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(90001, "Привет, мир — “да”", "ru"), (90002, "приветы миру", None), (90003, "世界 \u00a0 “你好”", "zh"), (90004, "好世 x", None), (90005, "“ ” — 12", "de"), (90006, "Ünïcode Straße ẞ", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r for r in langid.predict(df, langid.train(df)).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    assert [i for i in want if got[i].lang_pred != want[i][0]] == []
    assert all(got[i].score == pytest.approx(want[i][1], abs=1e-6) for i in want)


def test_the_sample_is_bounded(spark):
    df = spark.createDataFrame([(i, f"word{chr(97 + i)} same", "en") for i in range(20)], "doc_id long, text string, lang string")
    assert len(langid.train(df, most=4).tables[0].hashes) <= 5
    assert len(langid.train(df, most_bytes=1).tables[0].hashes) == 2


def test_sample_is_bounded_whatever_ids_repeat(spark):
    """Many rows of one id: no more rows and bytes are learned than the sample allows, and equal rows once."""
    rows = [(4, f"wort{i} etwas", "de") for i in range(500)] + [(4, "the same", "en")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, most=6, most_bytes=10**9)
    assert 0 < len(model.tables[0].hashes) <= 12
    small = langid.train(df, most=500, most_bytes=50)
    assert 0 < len(small.tables[0].hashes) <= 10
    only = langid.train(spark.createDataFrame([(4, "the same", "en")] * 300, df.schema))
    assert len(only.tables[0].hashes) == 2


def test_long_texts_in_parts(spark):
    """Parts of a text add up to its score; a text of millions of letters is predicted like its beginning."""
    train = spark.createDataFrame([(0, "the cat and the dog the", "en"), (1, "der hund und der mann der", "de")], "doc_id long, text string, lang string")
    model = langid.train(train)
    column = pa.array(["The cat, und der Hund " * 40, None, "", "x" * 90, "13 " * 30, "der mann"])
    whole, parts = langid.score_column(model, column), langid.score_column(model, column, 10)
    assert np.allclose(whole[0], parts[0]) and whole[1].tolist() == parts[1].tolist() == [True, False, False, True, False, True]
    assert list(langid.text_parts(["ab cdefgh i", ""], 4)) == [(0, "ab cdefgh"), (0, " i"), (1, "")]
    df = spark.createDataFrame([(2, "der hund " * 400_000), (3, "the cat " * 400_000)], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.predict(df, model).collect()} == {2: "de", 3: "en"}
