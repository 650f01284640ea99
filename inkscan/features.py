"""Queries over what is fitted, edited, put in words, read from arrays and grown."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkscan.functions.lineage import shared_path
from inkscan.operators import edits, evaluate, logistic, ngram
from inkscan.plans import analyze
from inkscan.sources.json_array import read_json_array

QUERIES = {}
#: The penalty of the fits below.
L2 = 0.1


def query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from inkscan.queries import table

    return table(spark, sf_dir, name)


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, symbols, shouts, length, y) of labelled documents; y: the label is 0."""
    text = F.coalesce("text", F.lit(""))
    share = lambda pattern, of: F.least(F.lit(1.0), F.regexp_count(text, F.lit(pattern)) * float(of) / F.greatest(F.length(text), F.lit(1)))
    docs = _table(spark, sf_dir, "documents").select("doc_id", share("[#*$%&|<>]", 10).alias("symbols"), share("!", 10).alias("shouts"), F.least(F.lit(1.0), F.length(text) / 5000).alias("length"))
    return docs.join(_table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).cast("double").alias("y")), "doc_id")


@query
def logistic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of at least 0, fitted over all labelled documents, and the slope of the penalised loss at them."""
    names = ["symbols", "shouts", "length"]
    fit = logistic.fit(logistic.feature_rows(_features(spark, sf_dir), [F.col(n) for n in names], F.col("y")), L2)
    values = zip(["bias", *names], [fit.bias, *fit.weights.tolist()], fit.slope.tolist(), strict=True)
    return spark.createDataFrame([(n, round(w, 5), round(g, 5) + 0.0) for n, w, g in values], "name string, weight double, slope double")


@query
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every labelled document, and the one that it would get from a fit without it."""
    df, x = _features(spark, sf_dir), [F.col("symbols")]
    fit = logistic.fit(logistic.feature_rows(df, x, F.col("y")), L2)
    out = logistic.leave_one_out(logistic.scored(df, fit, x), fit, x, F.col("y"))
    return out.select("doc_id", F.round(100 / (1 + F.exp(-F.col("z"))), 3).alias("score"), F.round("score_without", 3).alias("score_without"))


@query
def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with the added passage, its stock phrases replaced and its characters cleaned up."""
    from inkscan.queries import ADDED, texts

    fixed = edits.with_fixes(texts(spark, sf_dir, ADDED))
    return fixed.select("doc_id", F.md5(F.col("fixed.text").cast("binary")).alias("text_md5"), F.col("fixed.n_phrases").cast("long").alias("n_phrases"), F.col("fixed.removed").cast("long").alias("removed"))


@query
def advice_in_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per piece of advice of two detectors, told in English and in Russian."""
    from inkscan.queries import texts

    reports = analyze.analyze(texts(spark, sf_dir), ["doc_id"], ["R-01", "L-06"])
    told = [edits.in_words(reports, lang).select("doc_id", F.lit(lang).alias("lang"), F.explode("advice").alias("a")) for lang in ("en", "ru")]
    return told[0].unionByName(told[1]).select("doc_id", "lang", "a.rule", "a.title", "a.explain")


@query
def held_out_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC, FPR and TPR by language, by source and by both, from one pass; text length stands for a score."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    df = docs.join(_table(spark, sf_dir, "labels"), "doc_id").withColumn("label", F.col("quality") == 1).withColumn("score", F.col("n_chars").cast("double"))
    r = evaluate.held_out_report(df, "score", "label", ["lang", "source", ("lang", "source")], 1000)
    return r.select("grouping", "member", "n", *(F.round(c, 6).alias(c) for c in ("auc", "fpr", "tpr")))


def _as_array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's objects as one array, a line each."""
    first = True
    for batch in batches:
        lines = batch.column("line").to_pylist()
        if lines:
            yield pa.RecordBatch.from_arrays([pa.array([("[" if first else ",") + lines[0], *("," + x for x in lines[1:])])], names=["line"])
            first = False
    yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"])], names=["line"])


@query
def json_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as JSON arrays, one a file, and read again in ranges."""
    path = shared_path(spark, "arrays")
    rows = _table(spark, sf_dir, "documents").select(F.to_json(F.struct("doc_id", "text", "lang", "source", "n_chars")).alias("line"))
    rows.mapInArrow(_as_array, "line string").write.text(path)
    back = read_json_array(spark, path, "doc_id long, text string, lang string, source string, n_chars long")
    return back.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "lang", "source", "n_chars")


@query
def grown_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trigram model from the counts of two halves of the texts, which arrive one after the other."""
    from inkscan.queries import texts

    df, grown = texts(spark, sf_dir), ngram.GrowingModel(spark, shared_path(spark, "counts"))
    for half in (0, 1):
        grown.add(df.where(F.pmod(F.col("doc_id"), F.lit(2)) == half), half)
    model, alphabet = grown.model(3)
    return model.select("gram", "n", "context_n", F.lit(alphabet).cast("long").alias("alphabet"))
