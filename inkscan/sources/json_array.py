"""Large JSON arrays as rows: a file is read in byte ranges at once, and elements that cross a border are stitched.

Spark cuts a file into ranges and each range into pieces that end with a brace, so nothing needs a line
end.  What a range begins in, a string or not and how deep, follows from the ranges before it: the first
pass counts, for either beginning, what each range does to both, a row per range, and running sums
over those rows give every range its true beginning.  The second pass then finds the commas and brackets of
the array itself.  Elements that lie within a range are rows at once; the rest of a range, its first
and last part, meets its neighbours' by the number of the element that it belongs to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

END = "}"
RANGE = "file string, block long"
#: Characters that are worked on at once.
RUN = 1 << 20


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes]]:
    """(key columns, bytes) of consecutive pieces of one range, about ``RUN`` characters at once: what is worked on holds tens of bytes for each."""
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in batch.schema.names if c != "value"), strict=True))
        values, at = batch.column("value").to_pylist(), 0
        while at < len(keys):
            end = at
            size = 0
            while end < len(keys) and keys[end] == keys[at] and size < RUN:
                size += len(values[end])
                end += 1
            yield keys[at], "".join(v + END for v in values[at:end]).encode()
            at = end


def _structure(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quotes that open or close a string, and the change of depth at each byte, were it outside strings."""
    places = np.arange(len(data))
    solid = np.maximum.accumulate(np.where(data != ord("\\"), places, -1))  # the last byte that is no backslash
    before = np.concatenate([[-1], solid[:-1]])
    quote = (data == ord('"')) & ((places - 1 - before) % 2 == 0)
    change = np.isin(data, (ord("{"), ord("["))).astype(np.int8) - np.isin(data, (ord("}"), ord("]"))).astype(np.int8)
    return quote, change


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range: whether it leaves in the other state than it began in, and the change of depth if it began outside or inside a string."""
    open_, turned, depth = None, 0, [0, 0]

    def row() -> pa.RecordBatch:
        types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*open_, turned, *depth), types, strict=True)], names=["file", "block", "turned", "outside", "inside"])

    for key, raw in _runs(batches):
        if open_ is not None and key != open_:
            yield row()
            turned, depth = 0, [0, 0]
        open_ = key
        quote, change = _structure(np.frombuffer(raw, dtype=np.uint8))
        within = np.cumsum(quote) - quote
        for began in (0, 1):
            depth[began] += int(change[(within + turned + began) % 2 == 0].sum())
        turned = (turned + int(quote.sum())) % 2
    if open_ is not None:
        yield row()


PARTS = "file string, block long, place long, edge int, value string"


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of each range between borders of elements: edge 0 for whole ones, 1 for a first part, 2 for a last one, 3 for what has no border."""
    open_, text, place, whole = None, [], 0, True
    in_string, depth, out = 0, 0, []

    def part(edge: int) -> None:
        nonlocal place
        out.append((*open_[:2], place, edge, b"".join(text).decode()))
        text.clear()
        place += 1

    def close() -> None:
        if open_ is not None and depth >= 1:
            part(3 if whole else 2)
        text.clear()

    def flush() -> Iterator[pa.RecordBatch]:
        if out:
            types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[c.split()[0] for c in PARTS.split(", ")])
            out.clear()

    for key, raw in _runs(batches):
        if key != open_:
            close()
            open_, place, whole = key, 0, True  # whole: no border so far
            in_string, depth = key[2], key[3]
        data = np.frombuffer(raw, dtype=np.uint8)
        quote, change = _structure(data)
        free = ((np.cumsum(quote) - quote + in_string) % 2 == 0) & ~quote
        after = depth + np.cumsum(np.where(free, change, 0))
        before = np.concatenate([[depth], after[:-1]])
        comma, begin, end = (free & (data == ord(c)) & (before == d) for c, d in ((",", 1), ("[", 0), ("]", 1)))
        at = 0
        for i in np.flatnonzero(comma | begin | end).tolist():
            if not begin[i]:
                text.append(raw[at:i])
                part(1 if whole else 0)
            else:
                text.clear()
            at, whole = i + 1, False
        if len(after) and after[-1] >= 1:
            text.append(raw[at:])
        in_string, depth = (in_string + int(quote.sum())) % 2, int(after[-1])
        if len(out) > 1000:
            yield from flush()
    close()
    yield from flush()


def elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, place, value): the elements of the JSON arrays in the files under ``path``, as text.

    Sorted by (file, block, place) they stand in the file's order.  Each file holds one array; one that is empty or
    holds nothing but white space has no rows.  A compressed file is one range.
    """
    pieces = spark.read.option("lineSep", END).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    effects = pieces.mapInArrow(_effects, f"{RANGE}, turned int, outside long, inside long")
    past = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    states = effects.withColumn("in_string", (F.coalesce(F.sum("turned").over(past), F.lit(0)) % 2).cast("int"))
    states = states.withColumn("change", F.when(F.col("in_string") == 0, F.col("outside")).otherwise(F.col("inside")))
    states = states.select("file", "block", "in_string", F.coalesce(F.sum("change").over(past), F.lit(0)).alias("depth"))
    # a row per range of the files goes to all tasks; the pieces stay where they are, in order
    placed = pieces.join(F.broadcast(states), ["file", "block"]).select("file", "block", "in_string", "depth", "value")
    parts = placed.mapInArrow(_elements, PARTS)
    # at most two parts a range have no whole element: a last part begins one, those that follow go on
    edges = parts.where("edge > 0").withColumn("_of", F.sum(F.when(F.col("edge") == 2, 1).otherwise(0)).over(Window.partitionBy("file").orderBy("block", "place")))
    first = F.min(F.struct("block", "place")).alias("first")
    stitched = edges.groupBy("file", "_of").agg(first, F.array_sort(F.collect_list(F.struct("block", "place", "value"))).alias("parts"))
    stitched = stitched.select("file", "first.block", "first.place", F.array_join(F.transform("parts", lambda p: p["value"]), "").alias("value"))
    every = parts.where("edge = 0").select("file", "block", "place", "value").unionByName(stitched)
    return every.withColumn("value", F.btrim("value", F.lit(" \t\r\n"))).where("value <> ''")


def read_json_array(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The elements as columns of ``schema``; fields that lack are null, as is every field of an element that isn't JSON."""
    return elements(spark, path).select(F.from_json("value", schema).alias("e")).select("e.*")
