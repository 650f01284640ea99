"""A training corpus from ``documents``: quality, near copies, personal data, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkscan.llm import bpe, jaccard, mixing, pii, quality
from inkscan.llm.shared import new_path, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees; those go on as they are."""
    trees = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, trees, COLUMNS).where("kept").select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of every group of near copies; of rows that repeat an id and a text, one."""
    groups = jaccard.near_copies(docs)
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    kept = docs.select(*COLUMNS).join(first, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"]).select(*COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data, and terms that reveal it, replaced by their kinds; n_chars follows."""
    found = pii.find(docs, ["doc_id", "lang", "source"])
    masked = found.withColumn("text", pii.masked(F.col("text"), F.col("spans")))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    taken = mixing.mix(docs, COLUMNS).where("copies > 0")
    return taken.select(*COLUMNS, F.explode(F.expr("sequence(1L, copies)")).alias("copy")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix."""
    return bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("personal data", mask_personal_data),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]

#: Boosted trees, near copies and BPE have no SQL form; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = new_path(spark, f"stage-{i + 1}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
