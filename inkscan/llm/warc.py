"""WARC archives: records written and read back as files, and their index merged from sorted runs.

Every page is a record; of records with equal payloads the one with the largest id is the
response, the others revisit it.  Spark writes the records as files of the shared folder and reads them back
whole, each file in one task (files hold at most ``RECORDS`` records).  Every file gives a run of
index lines sorted by url key and time.  The lines are dealt by ranges of that key, and in each
range a tree of losers merges the runs, so the index comes out globally ordered: each url's
captures in time order.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkscan.llm.shared import new_path, partitions

#: Records in a file, the least payload that is not repeated, and the time of page 0's capture; each later page is a second later.
RECORDS, LEAST_BYTES, EPOCH = 1000, 0, 1_700_000_000
#: Bytes of payload that a file holds at most, but for a larger record; a file is read whole by one task.
FILE_BYTES = 1 << 26
END = "\r\n\r\n"


def base32_sha1(text: Column) -> Column:
    """The bare upper-case base32 of a SHA-1: twenty bits (five hex digits) are four of its letters."""
    digest = F.sha1(text.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.lower(F.concat(*parts)), "0123456789abcdefghijklmnopqrstuv", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: Column) -> Column:
    """A sort key that puts a host's urls together: the host's labels from last to first, then the rest."""
    host = F.lower(F.regexp_extract(url, r"(?s)\A[^:/?#]*://([^/?#]*)", 1))
    rest = F.regexp_replace(url, r"(?s)\A[^:/?#]*://[^/?#]*", "")
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest), F.lit(""))


def records(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, refers_to, record): the text of every page's WARC record."""
    df = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    df = df.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", base32_sha1(F.col("html")))
    # sums per digest are small rows, gathered in part before they move; only repeated digests take part in the join
    repeated = df.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    ids = df.select("page_id", F.col("payload_digest").alias("digest"), F.col("payload_bytes").alias("size"))
    revisits = ids.join(repeated, ids["digest"] == repeated["payload_digest"]).where((F.col("size") >= least_bytes) & (F.col("page_id") < F.col("response_id"))).select(F.col("page_id").alias("revisit_id"), "digest", F.col("response_id").alias("refers_to")).distinct()
    df = df.join(revisits, (df["page_id"] == revisits["revisit_id"]) & (df["payload_digest"] == revisits["digest"]), "left").drop("revisit_id", "digest")
    again = F.col("refers_to").isNotNull()
    safe_url = F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")
    header = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Target-URI: "), safe_url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("X-Payload-Bytes: "), F.col("payload_bytes").cast("string")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(again, 0).otherwise(F.col("payload_bytes")).cast("string")),
    )
    body = F.when(again, "").otherwise(F.col("html"))
    return df.select("page_id", "payload_bytes", "payload_digest", "refers_to", F.concat(header, F.lit(END), body).alias("record"))


def write(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, per_file: int = RECORDS, most_bytes: int = FILE_BYTES) -> None:
    """Gzipped WARC files of at most ``per_file`` records and about ``most_bytes`` bytes of payload each, or of one larger record.

    Pages are written by size: those above ``most_bytes / per_file`` have files of their own, of so many records fewer,
    a step for every power of four.  Equal payloads are of one size, so revisits stay with their responses.
    Each record ends with the two line ends that the format asks for.
    """
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    step = F.greatest(F.ceil(F.log(4.0, F.greatest(size, F.lit(1)) / max(1, most_bytes // per_file))), F.lit(0)).cast("int")
    # some ten steps at most, as a text has under 2**31 bytes; a corpus of usual pages has one
    for k in sorted(r[0] for r in pages.select(step.alias("step")).distinct().collect()) or [0]:
        some = records(pages.where(step == k), least_bytes).select("record")
        some.write.mode("append").option("lineSep", END).option("maxRecordsPerFile", max(1, per_file >> (2 * k))).option("compression", "gzip").text(path)


def parse(stream: BinaryIO) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers by lower-cased name, payload) of every record, by their lengths; one record is held at a time."""
    at = 0
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        size, headers = len(line), {}
        while (line := stream.readline()) != b"\r\n":
            if not line.endswith(b"\r\n"):
                raise ValueError(f"the record at byte {at} has no end")
            size += len(line)
            name, _, value = line[:-2].decode().partition(": ")
            headers[name.lower()] = value
        payload = stream.read(int(headers["content-length"]))
        stream.read(4)
        yield at, headers, payload
        at += size + 2 + len(payload) + 4


INDEX = "run string, url_key string, captured string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, offset long"
NAMES = [c.split()[0] for c in INDEX.split(", ")]


def _key_of(url: str) -> str:
    m = re.match(r"[^:/?#]*://([^/?#]*)", url)
    host, rest = (m[1], url[m.end() :]) if m else ("", url)
    return ",".join(reversed(host.lower().split("."))) + ")" + rest


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The index lines of each file, sorted: its run.  Payloads of responses are held against their digests."""
    number = re.compile(r"\d+|-\d+")
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            lines = []
            for offset, h, payload in parse(gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))):
                if h["warc-type"] == "response" and "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode() != h["warc-payload-digest"]:
                    raise ValueError(f"digest of the record at byte {offset} of {path}")
                page, to = (number.search(h.get(k, "")) for k in ("warc-record-id", "warc-refers-to"))
                url = h.get("warc-target-uri")
                lines.append((path, _key_of(url) if url is not None else "", h["warc-date"], int(page[0]) if page else None, url, h["warc-type"], int(h["x-payload-bytes"]), h["warc-payload-digest"][5:], int(to[0]) if to else None, offset))
            lines.sort(key=_order)
            types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines, strict=True), types, strict=True)] if lines else [pa.array([], t) for t in types], names=NAMES)


def _order(line: tuple) -> tuple:
    return line[1].encode(), line[2], -1 if line[3] is None else line[3], line[0], line[9]


def merge(sizes: list[int], key: Callable[[int, int], tuple]) -> Iterator[tuple[int, int]]:
    """(run, place) of sorted runs in their common order, by a tree of losers.

    ``key`` gives a run's key at a place; one cursor per run, and each step replays the winner's
    path, one comparison a level.
    """
    k = len(sizes)
    if not k:
        return
    at = [0] * k
    keys: list[tuple | None] = [key(r, 0) if sizes[r] else None for r in range(k)]

    def beats(a: int, b: int) -> bool:
        return keys[b] is None or keys[a] is not None and (keys[a], a) < (keys[b], b)

    losers = [-1] * k
    winner = [0] * (2 * k)
    for leaf in range(k):
        winner[k + leaf] = leaf
    for node in range(k - 1, 0, -1):
        a, b = winner[2 * node], winner[2 * node + 1]
        winner[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    best = winner[1] if k > 1 else 0
    while keys[best] is not None:
        yield best, at[best]
        at[best] += 1
        keys[best] = key(best, at[best]) if at[best] < sizes[best] else None
        node = (best + k) // 2
        while node:
            if beats(losers[node], best):
                losers[node], best = best, losers[node]
            node //= 2


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range of the index: its runs arrive one after another, each in order, and are merged where they lie."""
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    names = table.column("run").combine_chunks().dictionary_encode()
    code = names.indices.to_numpy()
    begin = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, dtype=np.int64)
    url_key, captured, page, offset = (table.column(c) for c in ("url_key", "captured", "page_id", "offset"))

    def key(run: int, place: int) -> tuple:
        i = int(begin[run]) + place
        page_id = page[i].as_py()
        return url_key[i].as_py().encode(), captured[i].as_py(), -1 if page_id is None else page_id, run, offset[i].as_py()

    sizes = np.diff(np.append(begin, len(code))).tolist()
    order = np.fromiter((begin[run] + place for run, place in merge(sizes, key)), dtype=np.int64, count=len(code))
    for i in range(0, len(order), 8192):
        yield from table.take(pa.array(order[i : i + 8192])).combine_chunks().to_batches()


#: Bytes of archive files whose index lines make one range.
RANGE_BYTES = 1 << 25


def read_index(spark, path: str) -> DataFrame:
    """The archive's index: one line per record, in order of url key and capture time over all partitions."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    size = files.agg(F.sum("length")).first()[0] or 0
    runs = files.select("path", "content").mapInArrow(_runs, INDEX)
    # one url may hold a third of the captures: times and ids split it into several ranges
    ranges = max(partitions(spark), size // RANGE_BYTES + 1)
    dealt = runs.repartitionByRange(ranges, "url_key", "captured", "page_id", "run", "offset")
    # a range's parts of the runs one after another; Spark's sort spills where it must
    return dealt.sortWithinPartitions("run", "url_key", "captured", "page_id", "offset").mapInArrow(_merged, INDEX)


def archive(pages: DataFrame, path: str | None = None, least_bytes: int = LEAST_BYTES, per_file: int = RECORDS, most_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes ``pages`` as WARC files under ``path`` (a new shared folder) and returns their merged index.

    Of records with equal payloads of at least ``least_bytes`` bytes, that of the largest page_id is
    the response and the others revisit it.  A null html is an empty payload; a null url leaves the
    target out, and line ends in a url are written as %0D and %0A; a null page_id is never revisited and revisits nothing.
    Every row gives a record; rows that repeat both the largest id and the payload are all responses.
    """
    path = path or new_path(pages.sparkSession, "warc")
    write(pages, path, least_bytes, per_file, most_bytes)
    return read_index(pages.sparkSession, path)
