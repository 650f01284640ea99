"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkscan.llm import mixing, oracle_sql, url_filter
from inkscan.llm.shared import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from inkscan.llm.bpe import encode_digests

    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkscan.llm import langid

    documents = table(spark, sf_dir, "documents")
    return langid.predict(documents, langid.train(documents))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkscan.llm.jaccard import near_copies

    return near_copies(table(spark, sf_dir, "documents")).drop("set_id")


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkscan.llm.embed_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkscan.llm import quality

    documents = table(spark, sf_dir, "documents")
    trees = quality.train(documents, table(spark, sf_dir, "labels"))
    return quality.judge(documents, trees, ["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_score"
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkscan.llm.warc import archive

    return archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), ["doc_id"]).drop("copies")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkscan.llm.pii import digests

    return digests(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkscan.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op11_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkscan.llm.discriminant import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkscan.llm.merkle import manifest

    return manifest(table(spark, sf_dir, "documents"))


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkscan.llm.periods import periodic_runs

    return periodic_runs(table(spark, sf_dir, "documents"), tails=True).drop("runs")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_urls": op2_urls,
    "op3_langid": op3_langid,
    "op4_jaccard": op4_jaccard,
    "op5_embeddings": op5_embeddings,
    "op6_quality": op6_quality,
    "op7_warc": op7_warc,
    "op8_mixing": op8_mixing,
    "op9_pii": op9_pii,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_discriminant": op11_discriminant,
    "op12_merkle": op12_merkle,
    "op13_periods": op13_periods,
}

ORACLES: dict[str, str] = {
    "op2_urls": url_filter.oracle(),
    "op4_jaccard": oracle_sql.JACCARD,
    "op5_embeddings": oracle_sql.EMBEDDINGS,
    "op7_warc": oracle_sql.WARC,
    "op8_mixing": mixing.ORACLE,
    "op12_merkle": oracle_sql.MERKLE,
    "op13_periods": oracle_sql.PERIODS,
}
