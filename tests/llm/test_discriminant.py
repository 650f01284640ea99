"""The discriminant against densities written out, its held-out accuracy, and its edges."""

import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from inkscan.llm import discriminant as d
from inkscan.llm.queries import QUERIES
from inkscan.llm.quality import COUNTS, MORE, with_statistics
from inkscan.llm.shared import table

SF = "/root/testdata/sf0.01"


def test_scores_are_log_density_differences():
    """Against normal densities with determinant and inverse written out, for covariances that are only shrunk."""
    draw = np.random.default_rng(3)
    x = {0: draw.normal(size=(30, d.WIDTH)) * np.arange(1, d.WIDTH + 1), 1: draw.normal(size=(400, d.WIDTH)) + 2}
    sums = {k: (float(len(v)), v.mean(axis=0), np.cov(v.T, bias=True)) for k, v in x.items()}
    model, at = d.fit(sums, 50, 0.1), draw.normal(size=(20, d.WIDTH)) * 3
    pooled = (30 * sums[0][2] + 400 * sums[1][2]) / 430
    unit = np.diag(1 / np.sqrt(np.diag(pooled)))
    log_density = []
    for k in (0, 1):
        n, mean, own = sums[k]
        shape = unit @ ((n * own + 50 * pooled) / (n + 50)) @ unit
        shape = 0.9 * shape + 0.1 * np.trace(shape) / d.WIDTH * np.eye(d.WIDTH)
        z = (at - mean) @ unit
        log_density.append(np.log(n / 430) - 0.5 * np.log(np.linalg.det(shape)) - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(shape), z))
    want = 1 / (1 + np.exp(log_density[0] - log_density[1]))
    assert np.allclose(model.score(at), want, rtol=1e-9, atol=1e-12)


def test_sums_over_partitions_equal_one_table(spark):
    """Means and covariances from Spark's sums are those of the labelled rows, whatever the partitions; held-out rows don't count."""
    documents, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    stats = with_statistics(documents.select("doc_id", "text"), ["doc_id"])
    models = [d.train(stats.repartition(n), labels) for n in (1, 7)]
    for a, b in ((models[0].bad, models[1].bad), (models[0].good, models[1].good)):
        assert np.array_equal(a.mean, b.mean) and np.array_equal(a.inverse, b.inverse) and a.offset == b.offset
    rows = {r.doc_id: r for r in stats.collect()}
    for k, model in ((0, models[0].bad), (1, models[0].good)):
        own = [rows[r.doc_id] for r in labels.where(f"quality = {k}").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
        x = d.features({c: np.array([r[c] for r in own]) for c in (*COUNTS, *MORE)})
        assert np.allclose(model.mean, x.mean(axis=0), rtol=1e-12)


def test_held_out_accuracy(spark):
    rows = QUERIES["op11_discriminant"](spark, SF).join(table(spark, SF, "labels").select("doc_id", "quality"), "doc_id", "left").collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    test = [r for r in rows if r.held_out and r.quality is not None]
    good, bad = [r.score for r in test if r.quality == 1], [r.score for r in test if r.quality == 0]
    assert sum(g > b for g in good for b in bad) >= 0.99 * len(good) * len(bad)
    assert sum(s >= 0.7 for s in good) >= 0.98 * len(good) and sum(s >= 0.7 for s in bad) <= 0.1 * len(bad)


def test_labels_and_names_are_no_input(spark):
    """lang, source and the id of a row don't move its score; labels of held-out rows don't either."""
    documents, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    want = {r.doc_id: r.score for r in d.classify(documents, labels).collect()}
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    got = {r.doc_id: r.score for r in d.classify(documents.withColumn("lang", F.lit("x")).withColumn("source", F.lit(None).cast("string")), flipped).collect()}
    assert got == want


def test_edges(spark):
    docs = [(1, "some words here"), (2, None), (3, ""), (3, "again 3"), (None, "no id"), (5, "*** ### " * 5000), (6, "b"), (7, " \n\t")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("quality", F.lit(0)).withColumn("n_words", F.lit("x")).withColumn("score", F.lit(None).cast("string"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = d.classify(df, none).collect()
    assert sorted((r.doc_id or 0) for r in rows) == [0, 1, 2, 3, 3, 5, 6, 7] and {r.score for r in rows} == {0.5}
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, None), (3, None, 0), (None, 1, 0), (5, 0, 0), (6, 1, 0), (7, 7, 0)], none.schema)
    rows = d.classify(df, labels).collect()
    assert len(rows) == 8 and all(math.isfinite(r.score) and 0 <= r.score <= 1 for r in rows)
    by_id = {r.doc_id: r for r in rows if r.doc_id in (2, 7)}
    assert by_id[2].score == by_id[7].score  # null and blank texts hold the same words: none
    assert d.classify(df.limit(0), labels).collect() == []
    one = spark.createDataFrame([(1, 1, 0), (6, 1, 0)], none.schema)
    assert {r.score for r in d.classify(df, one).collect()} == {0.75}
