import re

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import test_bpe, test_jaccard, test_pii


def test_each_stage_on_its_input(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        if i < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
        docs.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        kept.append(docs.collect())
    start = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    good, single, masked, mixed, encoded = kept
    assert all(start[r.doc_id] == r for r in good)
    clean = [d for d, r in labels.items() if r.quality == 1]
    assert sum(d in {r.doc_id for r in good} for d in clean) > 0.97 * len(clean)
    groups = test_jaccard.brute([(r.doc_id, r.text) for r in good])
    assert sorted(r.doc_id for r in single) == sorted({c for _, _, c in groups}) and all(start[r.doc_id] == r for r in single)
    assert sorted(r.doc_id for r in masked) == sorted(r.doc_id for r in single)
    for r in masked:
        spans, text = test_pii.brute(start[r.doc_id].text), start[r.doc_id].text
        assert r.n_chars == len(r.text) and not any(re.search(re.escape(text[int(s.split(":")[1]) : int(s.split(":")[2])]), r.text) for s in spans if s[0] in "ec")
        assert spans or r.text == text
    texts = {r.doc_id: r for r in masked}
    assert all(texts[r.doc_id] == r for r in mixed)
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encoded) == sorted((r.doc_id, *test_bpe.expected(r.text)) for r in mixed)


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 50


def test_edges_of_every_stage(spark, tmp_path):
    """Null ids and texts, repeated rows, a very long text, no rows, and more columns than documents has."""
    sf = tmp_path / "sf"
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    good = "these are some quite ordinary words of a text that has nothing to hide at all but mail me at ann@corp.example please "
    rows = [(1, good, "en", "a"), (1, good, "en", "a"), (2, None, None, None), (3, "", "en", "b"), (None, "an altogether other text without any name or address that a reader would find in the first one of them", None, None), (4, " ".join(f"w{i}" for i in range(200_000)), "en", "a"), (5, "few words", "en", "a")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp string, kept string, start int"
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "clash", "clash", 7) for r in rows], schema)
    for given in (docs, docs.where("false")):
        df = given
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            df = stage(spark, df, str(sf))
            path = f"{tmp_path}/{given.isEmpty()}-{i}"
            df.write.parquet(path)
            df = spark.read.parquet(path)
            if i < 4:
                assert df.columns == corpus_pipeline.COLUMNS
                df = df.withColumn("fp", F.lit("clash")).withColumn("label", F.lit(1)) if i % 2 else df
            if i == 1:
                assert df.count() == (0 if given.isEmpty() else 3)
        assert df.isEmpty() == given.isEmpty()
