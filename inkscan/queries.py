"""Registered queries over the driver's tables, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkscan import built, features
from inkscan.operators import evaluate, ngram, scoring
from inkscan.operators import findings as evidence
from inkscan.operators.base import REGISTRY
from inkscan.operators.calibrate import calibrate
from inkscan.operators.code import with_code_context
from inkscan.operators.normalize import normalize_text
from inkscan.plans import analyze
from inkscan.plans.context import with_context
from inkscan.sources.corpora import to_long

Query = Callable[[SparkSession, str], DataFrame]

#: Added to every text where the tables hold none of what an operator looks for.
ADDED = (
    " It is crucial to delve into the vibrant tapestry of ideas; moreover, it's worth noting (again) that it is not just fast, but it is careful — really — and"
    " often arguably seen as solid, sound and safe in 2020. Not only the price but also the pace matters - “so” they \"say\"... In conclusion, let me know if this may help!"
)
CODE_ADDED = "\n# Example usage:\nimport os\ndef load_items(first_name, other):\n    # create the list\n    user_total = 0\n    return user_total\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table.  Its splits are the session's (``spark.sql.files.maxPartitionBytes``); no text is shuffled to spread it.

    A table of one small file would come in one piece, so a local session deals it out.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
    return df.repartition(spark.sparkContext.defaultParallelism) if local and df.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism else df


def texts(spark: SparkSession, sf_dir: str, add: str = "") -> DataFrame:
    df = table(spark, sf_dir, "documents").select("doc_id", "text")
    return df.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(add))) if add else df


def detector(name: str, add: str = "") -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = analyze.detect(texts(spark, sf_dir, add), ["doc_id"], [name])
        return found.select("doc_id", F.round(f"`{name}`.value", 6).alias("value"), F.col(f"`{name}`.applicable").alias("applicable"), F.round(f"`{name}`.score", 6).alias("score"))

    return query


def detect_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_context(texts(spark, sf_dir)).select("doc_id", "lang", F.round("mixed_share", 6).alias("mixed_share"))


def text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, sentences and paragraphs by kind."""
    kind = lambda k: F.size(F.filter("paras", lambda p: p["kind"] == k)).cast("long")
    return with_context(texts(spark, sf_dir)).select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.size(F.array_distinct("words")).cast("long").alias("n_types"),
        F.size("sents").cast("long").alias("n_sentences"), F.aggregate("sents", F.lit(0), lambda a, s: a + s["n"]).cast("long").alias("sentence_words"),
        kind("text").alias("n_text"), kind("heading").alias("n_heading"), kind("list").alias("n_list"),
    )


def partial_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of four detectors, the smallest whole path through the engine."""
    ids = ["R-01", "R-02", "T-03", "L-05"]
    found = analyze.detect(texts(spark, sf_dir), ["doc_id"], ids)
    # of scores to six digits: what lies beyond differs between engines and decides where a sum is near a border
    found = found.select("doc_id", *(F.struct(F.round(f"`{d}`.score", 6).alias("score")).alias(d) for d in ids)).select("doc_id", scoring.combine(ids).alias("score"))
    return found.select("doc_id", "score", scoring.verdict(F.col("score")).alias("verdict"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = texts(spark, sf_dir)
    df = analyze.analyze(df, ["doc_id"], model=ngram.train(df, min_count=3))
    return df.select("doc_id", "score", "verdict", F.col("confidence.value").alias("confidence"), F.col("confidence.level").alias("level"), F.to_json("categories").alias("categories"), F.to_json("advice").alias("advice"), F.to_json("metrics").alias("metrics"), F.array_join("warnings", ",").alias("warnings"))


def detector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, ids = texts(spark, sf_dir), analyze.TEXT
    return analyze.detector_rows(analyze.detect(df, ["doc_id"], ids, ngram.train(df, min_count=3)), ["doc_id"], ids).select("doc_id", "id", "category", F.round("value", 6).alias("value"), "applicable", F.round("score", 6).alias("score"))


def rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.rejected(table(spark, sf_dir, "documents"), ["doc_id"])


def p01_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = texts(spark, sf_dir)
    model = ngram.train(df, min_count=3)
    found = ngram.with_perplexity(with_context(df), *model)
    return found.select("doc_id", F.round("P-01.value", 6).alias("value"), F.col("P-01.applicable").alias("applicable"), F.round("P-01.score", 6).alias("score"))


def ngram_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, alphabet = ngram.train(texts(spark, sf_dir), min_count=3)
    return model.select("gram", "n", "context_n", F.lit(alphabet).cast("long").alias("alphabet"))


def normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = F.concat(F.coalesce("text", F.lit("")), F.lit(" pаypаl c​ode αlpha"))
    df = table(spark, sf_dir, "documents").select("doc_id", normalize_text(mixed).alias("n"))
    return df.select("doc_id", F.md5(F.col("n.text").cast("binary")).alias("text_md5"), F.col("n.replaced").cast("long").alias("replaced"), F.col("n.removed").cast("long").alias("removed"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").withColumn("label", F.col("quality") == 1).withColumn("score", F.col("n_chars").cast("double"))


def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of text length as a score of quality, per language; labels only show the metric at work."""
    return evaluate.roc_auc(_labelled(spark, sf_dir), "score", "label", ["lang"]).select("lang", F.round("auc", 6).alias("auc"))


def fpr_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.threshold_metrics(_labelled(spark, sf_dir), "score", "label", 1000, ["lang"]).select("lang", F.round("fpr", 6).alias("fpr"), F.round("f1", 6).alias("f1"))


def dedupe_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.dedupe_by_prefix(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "source")


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return evaluate.stratified_split(df, ["lang", "source"], ["doc_id"]).select("doc_id", "lang", "source", "is_test")


def capped_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 20 documents of each language and source, in the order of a hash that SQL has too."""
    df = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").withColumn("h", F.md5(F.col("doc_id").cast("string")))
    return evaluate.capped(df, ["lang", "source"], ["h", "doc_id"], 20).select("doc_id", "lang", "source")


def top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return df.orderBy(F.desc("n"), "source").limit(30)


def session_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three turns of each conversation, as versions of a session."""
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return scoring.keep_last(df, "conv_id", "turn", 3)


def recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the added passage changes in every document's report."""
    model = ngram.train(texts(spark, sf_dir), min_count=3)
    before, after = (analyze.analyze(texts(spark, sf_dir, add), ["doc_id"], model=model) for add in ("", ADDED))
    d = scoring.diff(before, after, "doc_id")
    return d.select("doc_id", "score_before", "score_after", *(F.array_join(F.array_sort(c), ",").alias(c) for c in ("closed", "opened", "remaining")), F.size("metrics").cast("long").alias("n_moved"))


def code_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-01 to C-05 over the text of every conversation turn with a passage of code."""
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), F.lit(CODE_ADDED)).alias("code"))
    ctx = with_code_context(df).select("conv_id", "turn", "language", *(REGISTRY[d]().alias(d) for d in analyze.CODE))
    return ctx.select("conv_id", "turn", "language", *(F.round(f"`{d}`.{x}", 6).alias(f"{d[0].lower()}{d[2:]}_{x}") for d in analyze.CODE for x in ("value", "score")))


def sentence_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heat per line of every text from its dashes, question marks and exclamation marks, each a span of weight 1."""
    from inkscan.functions.regexlib import spans_of

    df = texts(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lines = df.select("doc_id", F.explode(spans_of(F.col("text"), "[^\\n]+")).alias("s")).select("doc_id", "s.start", "s.end", F.lit(50.0).alias("overall"))
    spans = df.select("doc_id", F.explode(spans_of(F.col("text"), "[-!?]")).alias("s")).select("doc_id", "s.start", "s.end", F.lit(0.3).alias("weight"))
    return scoring.sentence_heat(lines, spans, "doc_id")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of dashes, markers, triads and contrasts in texts with the added passage."""
    ids = ["T-03", "L-01", "S-02", "S-06"]
    return evidence.finding_spans(analyze.detect(texts(spark, sf_dir, ADDED), ["doc_id"], ids), ["doc_id"], ids).withColumn("score", F.round("score", 6))


def report_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, ids = texts(spark, sf_dir, ADDED), ["T-03", "L-01", "S-02", "S-06"]
    return evidence.heat_of_results(analyze.detect(df, ["doc_id"], ids).withColumn("overall", scoring.combine(ids)), "doc_id")


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of four detectors fitted to the quality labels, which only show the fit at work."""
    ids = ["R-01", "R-02", "L-05", "L-06"]
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")
    results = analyze.detect(texts(spark, sf_dir), ["doc_id"], ids).join(labels, F.col("doc_id") == F.col("id"))
    bias, weights = calibrate(results, "quality", ids, 0.1)
    return spark.createDataFrame([("bias", bias), *weights.items()], "name string, weight double")


def labels_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_long(table(spark, sf_dir, "labels"), ["doc_id"], ["quality", "toxic"], "label", "value")


QUERIES: dict[str, Query] = {
    "detect_lang": detect_lang,
    "text_counts": text_counts,
    "partial_score": partial_score,
    "reports": reports,
    "detector_rows": detector_rows,
    "rejected": rejected,
    **{name.replace("-", "").lower(): detector(name, add) for name, add in (
        ("T-01", " pаypаl sοund plain"), ("T-02", " a​b c­d"), ("T-03", ADDED), ("T-04", ADDED), ("T-05", " **bold** and `code` and [a](b)"), ("T-06", ""),
        ("R-01", ""), ("R-02", ""), ("R-03", ""), ("R-04", ""), ("R-05", ""),
        ("L-01", ADDED), ("L-02", ""), ("L-03", ""), ("L-04", ADDED), ("L-05", ADDED), ("L-06", ""), ("L-07", ADDED),
        ("S-01", ADDED), ("S-02", ""), ("S-03", ""), ("S-04", ""), ("S-05", ""), ("S-06", ADDED), ("S-07", ADDED), ("S-08", ""), ("B-01", " [1, p. 3-5] [2] [3; 4, p. 9] [5]"), ("P-02", ""),
    )},
    "p01": p01_perplexity,
    "ngram_train": ngram_train,
    "normalise": normalise,
    "roc_auc": roc_auc,
    "fpr_f1": fpr_f1,
    "dedupe_prefix": dedupe_prefix,
    "stratified_split": stratified_split,
    "capped_sample": capped_sample,
    "top_sources": top_sources,
    "session_history": session_history,
    "recheck": recheck,
    "code_detectors": code_detectors,
    "sentence_heat": sentence_heat,
    "findings": findings,
    "report_heat": report_heat,
    "calibration": calibration,
    "labels_long": labels_long,
    **built.QUERIES,
    **features.QUERIES,
}
