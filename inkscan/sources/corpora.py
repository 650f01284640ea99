"""Corpora of labelled texts, and reports as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkscan.functions.regexlib import trim

SAMPLE = "lang string, ai boolean, model string, source string, text string"


def split_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): the texts of files in which lines of ``===`` stand between them."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    parts = files.select("path", F.explode(F.split("value", r"(?m)^===[ \t\r]*$")).alias("text")).select("path", trim(F.col("text")).alias("text"))
    return parts.where("text <> ''")


def samples(spark: SparkSession, path: str) -> DataFrame:
    """Lines of JSON, gzipped or not, as ``SAMPLE``."""
    return spark.read.schema(SAMPLE).json(path)


def from_csv(spark: SparkSession, path: str, text: str, label: str, lang: str, source: str, human: str = "human") -> DataFrame:
    """As ``SAMPLE``, of a CSV with a text and a label column: any label but ``human`` is a model's name."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    ai = F.lower(F.col(label)) != human
    return df.select(F.lit(lang).alias("lang"), ai.alias("ai"), F.when(ai, F.col(label)).otherwise(human).alias("model"), F.lit(source).alias("source"), trim(F.col(text)).alias("text"))


def from_wide(df: DataFrame, human: str, models: list[str], lang: str, source: Column | str) -> DataFrame:
    """As ``SAMPLE``, of a table with a column for people and one for each model."""
    source = F.lit(source) if isinstance(source, str) else source
    rows = df.select(source.alias("source"), human, *models).unpivot(["source"], [human, *models], "model", "text")
    ai = F.col("model") != human
    return rows.select(F.lit(lang).alias("lang"), ai.alias("ai"), F.when(ai, F.col("model")).otherwise("human").alias("model"), "source", trim(F.col("text")).alias("text"))


def to_long(df: DataFrame, keys: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """One row per key and column."""
    return df.unpivot(keys, columns, name, value)


def write_reports(reports: DataFrame, path: str) -> None:
    """A JSON line per report, with the time of writing."""
    reports.withColumn("generatedAt", F.current_timestamp()).write.mode("append").json(path)
