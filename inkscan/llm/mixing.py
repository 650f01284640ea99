"""Mixing sources to target weights.

Sizes (words) are summed per source, targets follow from the weights, and a source's repetition
rate is its target over its size.  A document is taken floor(rate) times, and once more if a draw
seeded by its id falls under the fraction.  Only sums per source are shuffled; the table of
sources has one row per source and no column of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkscan.llm.shared import cut

#: Weights by a source's place in order, repeating, and the most that a source may be repeated.
WEIGHTS, MOST = (1.0, 2.0, 3.0), 3
#: Sources up to which their table is sent to all tasks.
SENT_SOURCES = 100_000


def words_of(text: Column) -> Column:
    """The number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _placed(sources: DataFrame) -> DataFrame:
    """``sources`` with each one's place in code point order, null last; partitions are counted, not gathered."""
    ranged = cut(sources.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id()))
    running = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    parts = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return ranged.join(parts, "part").withColumn("place", own + F.col("before") - 1).drop("part", "before")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target): shares by weight of the whole, none over ``most`` times its size.

    What a source can't take goes to the others by weight, again and again until none is over: the
    level rises until nothing changes, each time from two sums over the sources.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int") + 1)
    df = cut(_placed(sizes).withColumn("weight", weight).withColumn("most", F.col("source_size") * float(most)))
    total = df.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        full = F.col("most") <= F.col("weight") * level
        spent, open_ = df.agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        risen = (total - spent) / open_ if open_ else level
        if not open_ or risen <= level:
            break
        level = risen
    return df.select("source", "source_size", F.least(F.col("most"), F.col("weight") * F.lit(float(level))).alias("target"))


def mix(documents: DataFrame, keep: list[str], weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``keep``, size, source_size, target, copies and taken (words) for every document.

    A null text has size 0; a null source is a source of its own, the last; a source without words
    has target 0.  Repeated rows of an id have the same draw.  copies is at most ``most``.
    """
    df = documents.select(*(F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)), F.col("doc_id").alias("own_id"), F.col("source").alias("own_source"), words_of(F.col("text")).alias("size"))
    by_source = targets(documents.select("source", words_of(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    by_source = cut(by_source.withColumnRenamed("source", "its_source"))
    # a row per source: where there are few, documents stay where they are; else adaptive execution splits a large source
    small = F.broadcast(by_source) if by_source.count() <= SENT_SOURCES else by_source
    joined = df.join(small, F.col("own_source").eqNullSafe(F.col("its_source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor(rate) + F.when(draw(F.col("own_id")) < rate - F.floor(rate), 1).otherwise(0)
    out = joined.withColumn("copies", copies.cast("long"))
    return out.select(*(F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


#: DuckDB: the level in closed form, from the sources in the order in which they fill up.
ORACLE = r"""
WITH sized AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
placed AS (SELECT source, source_size, 3.0::DOUBLE * source_size AS most,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END AS weight FROM sources),
filled AS (SELECT *, row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS k,
    coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS spent,
    sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
    (SELECT sum(source_size) FROM sources)::DOUBLE AS total FROM placed),
level AS (SELECT arg_min((total - spent) / open, k) AS level FROM filled WHERE most / weight > (total - spent) / open),
target AS (SELECT source, source_size, CASE WHEN level IS NULL THEN least(most, 0.0) ELSE least(most, weight * level) END AS target FROM placed CROSS JOIN level),
rated AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw
  FROM sized JOIN target ON sized.source IS NOT DISTINCT FROM target.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rated"""
