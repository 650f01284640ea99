"""Byte-level BPE encoding and decoding by overlapping chunks.

A long text is cut into chunks that overlap.  Each chunk is pre-tokenised on its own, in
parallel; in the overlap of two neighbours the pre-token boundaries of both are compared, and
the first boundary that both have is the stitch: from it on the two agree, as the pattern looks
only forward.  It must not stand after white space, which looks at the character behind it.  The
pieces between stitches are then encoded in parallel.  Where an overlap has no common boundary, as
inside a run of a million letters, the two chunks are joined, pre-tokenised anew and stitched with
the next; the rest of the text keeps its pieces.  Texts of one chunk need no stitching and are
encoded where they are read.  Decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkscan.llm.bytesops import give_back
from inkscan.llm.shared import cut, small_batches

CHUNK = 1 << 16
OVERLAP = 1 << 12
#: Code points beyond which a piece is encoded pre-token by pre-token: the library's own pattern search
#: recurses in long runs of white space.
WHOLE = 1 << 18

_loaded: dict[tuple[str, str], "Codec"] = {}


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Codec:
    """One vocabulary: ranks from a file of base64 tokens, and the pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        ranks = _ranks(path)
        self.pretoken = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._path = path
        by_id = sorted((rank, token) for token, rank in ranks.items())
        self.tokens = np.frombuffer(b"".join(t for _, t in by_id), dtype=np.uint8)
        lengths = np.zeros(by_id[-1][0] + 1, dtype=np.int64)
        lengths[[r for r, _ in by_id]] = [len(t) for _, t in by_id]
        self.lengths = lengths
        self.starts = np.cumsum(lengths) - lengths

    @cached_property
    def single(self):
        """Encodes a whole text as one pre-token; few tasks need it."""
        import tiktoken

        return tiktoken.Encoding("single", pat_str="(?s:.+)", mergeable_ranks=_ranks(self._path), special_tokens={})

    def boundaries(self, text: str) -> list[int]:
        """Ends of the pre-tokens of a text that starts at one."""
        return [m.end() for m in self.pretoken.finditer(text)]

    def encode(self, text: str) -> np.ndarray:
        if len(text) > WHOLE:
            each = [self.single.encode_ordinary(m[0]) for m in self.pretoken.finditer(text)]
            return np.fromiter((i for ids in each for i in ids), dtype="<u4")
        return np.asarray(self.encoding.encode_to_numpy(text, disallowed_special=()), dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.tokens[at].tobytes()


def codec(path: str, pattern: str) -> Codec:
    """The worker's own copy; the file is read once in each."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Codec(path, pattern)
    return _loaded[path, pattern]


def stitch(own: str, overlap: str, c: Codec) -> int | None:
    """Where chunk ``own`` (its last part is ``overlap``) and the next, which starts at the overlap, first agree.

    Counted from the overlap's start.  A pre-token that ends where the shared text ends may have
    been cut there, and white space before it may lose its lookahead; such ends don't count.  Nor do
    ends of white space: at the end of a piece it would lose its lookahead as well.
    """
    base = len(own) - len(overlap)
    usable = len(overlap) - 2
    mine = {b - base for b in c.boundaries(own) if base <= b <= base + usable}
    return next((b for b in [0, *c.boundaries(overlap)] if b in mine and b <= usable and not own[base + b - 1 : base + b].isspace()), None)


def _digest(ids: np.ndarray, c: Codec) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digest_batch(batch: pa.RecordBatch, found: list[tuple[int, str, str]], *keep: str) -> pa.RecordBatch:
    n, a, b = zip(*found, strict=True) if found else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), *map(batch.column, keep)],
        names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *keep],
    )


def long_pieces(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(row, doc_id, piece, text): the texts of over ``chunk`` code points, cut at stitches.

    Concatenated by ``piece`` the texts of a row are the document, and every cut is a pre-token
    boundary of the whole.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            own, shared = batch.column("own").to_pylist(), batch.column("shared").to_pylist()
            found = [stitch(a, b, c) if b else None for a, b in zip(own, shared, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("i"), pa.array(found, pa.int64())], names=["row", "i", "stitch"]
            )

    # the last chunk has no overlap behind it
    cut_up = docs.select("row", "doc_id", "text", F.length("text").cast("long").alias("n")).select(
        "row", "doc_id", "text", "n", F.explode(F.expr(f"sequence(0L, (n - 1) div {chunk})")).alias("i")
    )
    start = (F.col("i") * chunk).cast("int")
    chunks = cut_up.select(
        "row", "doc_id", "i", F.substring(F.col("text"), start + 1, F.lit(chunk)).alias("body"),
        F.substring(F.col("text"), start + 1 + chunk, F.lit(overlap)).alias("shared"),
    ).repartition("row", "i")
    # A unit is one chunk or several joined; one that isn't stitched takes in the next, and is searched again.
    order, row, found = Window.partitionBy("row").orderBy("i"), Window.partitionBy("row"), "row long, i long, stitch long"
    units = chunks.select("row", "i", F.concat("body", "shared").alias("own"), "shared").mapInArrow(find, found)
    units = cut(units.withColumn("last", F.col("i")).withColumn("ends", F.col("i") == F.max("i").over(row)))
    while not units.where("stitch is null and not ends").isEmpty():
        joins = F.lag(F.col("stitch").isNull()).over(order)
        unit = F.sum(F.when(joins, 0).otherwise(1)).over(order)
        units = units.withColumn("unit", unit).groupBy("row", "unit").agg(
            F.min("i").alias("i"), F.max_by("stitch", "last").alias("stitch"), F.max("last").alias("last"), F.max("ends").alias("ends"), F.count("*").alias("n")
        ).drop("unit")
        wide = units.where("n > 1 and not ends").select("row", F.col("i").alias("first"), F.explode(F.expr("sequence(i, last)")).alias("i"))
        wide = wide.join(chunks, ["row", "i"]).groupBy("row", "first").agg(
            F.array_sort(F.collect_list(F.struct("i", "body"))).alias("bodies"), F.max_by("shared", "i").alias("shared")
        )
        text = F.array_join(F.transform("bodies", lambda s: s["body"]), "")
        again = wide.select("row", F.col("first").alias("i"), F.concat(text, F.col("shared")).alias("own"), "shared").mapInArrow(find, found)
        units = units.join(again.withColumnRenamed("stitch", "anew"), ["row", "i"], "left")
        units = cut(units.select("row", "i", F.when((F.col("n") > 1), F.col("anew")).otherwise(F.col("stitch")).alias("stitch"), "last", "ends"))
    # each unit gives its head, up to the stitch with the one before, to that one's piece
    marks = units.select("row", F.col("i").alias("piece"), "last", F.lag("stitch").over(order).alias("head"), F.lag("i").over(order).alias("before"))
    marks = marks.select("row", "piece", "before", F.explode(F.expr("sequence(piece, last)")).alias("i"), "head")
    marks = marks.withColumn("head", F.when(F.col("i") == F.col("piece"), F.coalesce("head", F.lit(0))).otherwise(0).cast("int"))
    parts = chunks.select("row", "doc_id", "i", "body").join(marks, ["row", "i"]).select(
        "row", "doc_id",
        F.explode(F.array(
            F.struct(F.coalesce("before", F.lit(0)).alias("piece"), (F.col("i") * 2).alias("i"), F.substring(F.col("body"), F.lit(1), F.col("head")).alias("text")),
            F.struct(F.col("piece").alias("piece"), (F.col("i") * 2 + 1).alias("i"), F.expr("substring(body, head + 1)").alias("text")),
        )).alias("p"),
    ).select("row", "doc_id", "p.*")
    return parts.groupBy("row", "doc_id", "piece").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda s: s["text"]), "").alias("text")
    )


def encode_digests(documents: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 and decoded_sha256.

    ids_sha256 is over the ids as little-endian 32-bit integers, decoded_sha256 over the bytes
    they decode to.  A null text counts as empty: no tokens, and the digests of nothing.  Every
    input row gives a row, repeated ones too; other columns are ignored; a null doc_id stays.
    A text of over ``chunk`` code points is encoded as pieces on as many tasks.
    """

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            yield _digest_batch(batch, [_digest(c.encode(t or ""), c) for t in batch.column("text").to_pylist()])
        give_back()

    def piece_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            ids = [c.encode(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("piece"), pa.array(ids, pa.binary())],
                names=["row", "doc_id", "piece", "ids"],
            )

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            rows = batch.column("pieces").to_pylist()
            yield _digest_batch(batch, [_digest(np.frombuffer(b"".join(p["ids"] for p in row), dtype="<u4"), c) for row in rows], "row")

    small_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    is_long = F.coalesce(F.length("text") > chunk, F.lit(False))
    small = docs.where(~is_long).mapInArrow(short, DIGEST)
    # repeated rows have equal results: they share the work and are multiplied back
    large = docs.where(is_long).groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
    large = large.withColumn("row", F.xxhash64("doc_id", "text"))
    pieces = long_pieces(large, path, pattern, chunk, overlap).mapInArrow(
        piece_ids, "row long, doc_id long, piece long, ids binary"
    )
    joined = pieces.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("pieces"))
    digests = joined.mapInArrow(whole, DIGEST + ", row long").join(large.select("row", "copies"), "row")
    repeated = digests.withColumn("copy", F.explode(F.expr("sequence(1L, copies)"))).select(*small.columns)
    return small.unionByName(repeated)
