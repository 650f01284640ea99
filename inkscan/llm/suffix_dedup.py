"""Repeated passages by a logarithmic index family of sparse suffix arrays.

A byte goes if a 100-byte string that covers it also starts earlier.  Suffixes are sampled by
content: of the 32-byte prefixes of the 69 suffixes that begin in a 100-byte string and fit in it,
the least hash names the string's sample, so equal strings have equal samples at equal places.
About one suffix in 35 is a sample; a sample stands for the strings around it that it was chosen for.

1. Samples whose prefix occurs once in the corpus can't be part of a repeat.  The others are
   marked in a bit table of a fixed size, which may mark too many, never too few.
2. Every marked sample goes, with the bytes around it that its strings cover, to the partition of
   its prefix.  Equal surroundings within a batch are settled there, byte by byte: the first one
   goes on, later ones are repeats.  A prefix with very many surroundings goes string by string, to
   the partition of each string, where copies are settled before they move.
3. In a partition every batch gets a suffix array of its samples: their order by the bytes that
   follow and by the bytes before, read backwards.  It is merge-scanned against every level of the
   index: in the merged order, two samples share a string if the common bytes behind and before add
   up to it, and of those that share it all but the earliest lose it.  Samples that have lost all
   their strings leave; then the batch becomes a level, and levels of about equal size merge.
4. The removed ranges of each document meet its text in one join.

Strings are compared by their bytes; hashes only choose samples and partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkscan.llm.bytesops import in_slices, mix, pieces, text_bytes, window_hashes
from inkscan.llm.shared import partitions

U64 = np.uint64
LENGTH = 100
PREFIX = 32
#: Bits of the table of prefixes that occur more than once.
MARK_BITS = 27
MARK_CHUNK_BITS = 19
#: Bytes of surroundings that enter the index as one batch.
BATCH = 1 << 22
#: A prefix of more different surroundings than this, counted per batch, is dealt string by string; at 2**20 prefixes at most.
HOT = 50_000
_LOW = U64((1 << 32) - 1)


class Samples:
    """The samples of a batch: prefix hash, place, row, and the first and last start of the strings each is for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, prefix: int):
        keys = window_hashes(data, prefix)
        n, width = len(data) - length + 1, length - prefix + 1  # strings, and samples to choose from in each
        if n <= 0:
            self.key, self.around = np.zeros(0, dtype=U64), np.zeros(0, dtype=U64)
            self.at, self.row, self.first, self.last = (np.zeros(0, dtype=np.int64) for _ in range(4))
            return
        # the hash above, the place below: the minimum tells the leftmost place of the least hash
        place = np.arange(len(keys), dtype=U64)
        low = (keys & ~_LOW) | place
        reach = 1
        while reach * 2 <= width:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if reach < width:
            low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
        at = (low & _LOW).astype(np.int64)
        ends = np.zeros(len(data) + 1, dtype=np.int32)
        np.add.at(ends, offsets[1:-1], 1)
        text = np.cumsum(ends)
        starts = np.flatnonzero(text[:n] == text[length - 1 : length - 1 + n])  # strings that lie in one text
        at = at[starts]
        # strings of one sample stand together; two texts never share one
        change = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (np.diff(starts) > 1)])) if len(starts) else starts
        self.first, self.last = starts[change], starts[np.append(change[1:], len(starts)) - 1] if len(starts) else starts
        self.at = at[change]
        self.key, self.row = keys[self.at], np.searchsorted(offsets, self.first, side="right") - 1
        with np.errstate(over="ignore"):  # tells surroundings apart; what it mixes up is compared by its bytes
            self.around = mix(self.key + keys[self.first] * U64(3) + keys[self.last + length - prefix] * U64(5) + (self.last - self.first).astype(U64))


def _batch_samples(column: pa.Array, length: int, prefix: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, "Samples"]]:
    data, offsets = text_bytes(column)
    for a, b in pieces(offsets):
        if offsets[b] > offsets[a]:
            part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            yield part, at, a, Samples(part, at, length, prefix)


def _marks(documents: DataFrame, length: int, prefix: int, bits: int, size: int, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """A bit per hash of a prefix that occurs more than once, and the prefixes of more than ``hot`` surroundings, ascending.

    Both have a fixed size at most: the surroundings of all are about a 35th of the bytes, and
    ``hot`` rises with them.
    """
    chunk = min(MARK_CHUNK_BITS, bits)
    groups = max(bits - chunk, min(bits - 3, (size // 140_000_000).bit_length()))  # a group holds a few million keys
    hot = max(hot, size // 35 >> 20)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(s.key, s.around) for _, _, _, s in _batch_samples(batch.column("text"), length, prefix)]
            if not found:
                continue
            key, around = _spread(np.concatenate([k for k, _ in found])), np.concatenate([x for _, x in found])
            each = key[np.unique(around, return_index=True)[1]]
            key, count = np.unique(key, return_counts=True)
            loads = np.bincount(np.searchsorted(key, each), minlength=len(key))
            load = (np.minimum(loads, 32767) * 2 + (count > 1)).astype(np.uint16)
            group = (key >> U64(64 - groups)).astype(np.int32) if groups else np.zeros(len(key), dtype=np.int32)
            at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(key) else group
            blobs = [[p.tobytes() for p in np.split(x, at[1:])] if len(key) else [] for x in (key, load)]
            yield pa.RecordBatch.from_arrays([pa.array(group[at]), pa.array(blobs[0], pa.binary()), pa.array(blobs[1], pa.binary())], names=["group", "keys", "loads"])

    def repeated(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        found, load = (np.concatenate([np.frombuffer(k.as_py(), dtype=t) for k in table.column(c)]) for c, t in (("keys", U64), ("loads", np.uint16)))
        order = np.argsort(found)
        found, load = found[order], load[order]
        first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
        total = np.add.reduceat((load >> 1).astype(np.int64), first)
        again = (np.diff(np.append(first, len(found))) > 1) | (np.maximum.reduceat(load & 1, first) == 1)
        flags = np.zeros(1 << (bits - groups), dtype=bool)
        flags[(found[first[again]] >> U64(64 - bits) & U64(len(flags) - 1)).astype(np.int64)] = True
        blobs = [pa.array([x.tobytes()], pa.binary()) for x in (np.packbits(flags, bitorder="little"), found[first[total > hot]])]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), *blobs], names=["group", "bits", "hot"])

    out, some = np.zeros(1 << (bits - 3), dtype=np.uint8), [np.zeros(0, dtype=U64)]
    step = 1 << (bits - groups - 3)
    found = documents.select("text").mapInArrow(keys, "group int, keys binary, loads binary")
    for row in found.groupBy("group").applyInArrow(repeated, "group int, bits binary, hot binary").collect():
        out[row["group"] * step : (row["group"] + 1) * step] = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
        some.append(np.frombuffer(bytes(row["hot"]), dtype=U64))
    return out, np.sort(np.concatenate(some))


def _spread(key: np.ndarray) -> np.ndarray:
    """Samples have small hashes, as they are minima; these are spread evenly."""
    return mix(key ^ U64(0x5DEECE66D1CE4E5B))


def _marked(table: np.ndarray, spread: np.ndarray) -> np.ndarray:
    slot = (spread >> U64(64 - 3 - int(np.log2(len(table))))).astype(np.int64)
    return (table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


#: A sample's surroundings: document, first byte, number of bytes, and the sample's place in them.
HEAD = np.dtype([("doc", "<i8"), ("start", "<i8"), ("size", "<i4"), ("at", "<i4")])


def _rows_of(raw: np.ndarray, begin: np.ndarray, count: np.ndarray, width: int, step: int = 1) -> np.ndarray:
    """``count`` bytes from each ``begin``, forwards or backwards, as rows of ``width`` bytes that end in zeros."""
    column = np.arange(width)
    at = np.clip(begin[:, None] + column * step, 0, max(0, len(raw) - 1))
    return np.where(column < count[:, None], raw[at], 0).astype(np.uint8) if len(raw) else np.zeros((len(begin), width), dtype=np.uint8)


def _common(rows: np.ndarray) -> np.ndarray:
    """How many bytes each row shares with the one before; -1 for the first."""
    if not len(rows):
        return np.zeros(0, dtype=np.int64)
    m = rows.view(np.uint8).reshape(len(rows), -1)
    differ = m[1:] != m[:-1]
    return np.concatenate([[-1], np.where(differ.any(axis=1), differ.argmax(axis=1), m.shape[1])])


class SuffixArray:
    """Samples in the order of (document, place), and sorted by the bytes behind and by those before them.

    A sample has the strings that start ``low`` to ``high`` bytes before it; ``lost`` says which of
    them start earlier elsewhere.
    """

    def __init__(self, doc, at, low, high, behind, before, lost, by_behind=None, by_before=None):  # noqa: ANN001
        self.doc, self.at, self.low, self.high, self.behind, self.before, self.lost = doc, at, low, high, behind, before, lost
        self.by_behind = np.argsort(behind) if by_behind is None else by_behind
        self.by_before = np.argsort(before) if by_before is None else by_before

    @classmethod
    def of(cls, head: np.ndarray, raw: np.ndarray, length: int, prefix: int) -> "SuffixArray":
        begin = np.cumsum(head["size"], dtype=np.int64) - head["size"] + head["at"]
        order = np.lexsort((head["start"] + head["at"], head["doc"]))
        head, begin = head[order], begin[order]
        behind = _rows_of(raw, begin, head["size"] - head["at"], length).view(f"S{length}").ravel()
        width = max(1, length - prefix)
        before = _rows_of(raw, begin - 1, head["at"], width, -1).view(f"S{width}").ravel()
        low = head["at"] - (head["size"] - length)
        return cls(head["doc"].copy(), head["start"] + head["at"], low, head["at"].copy(), behind, before, np.zeros((len(head), length - prefix + 1), dtype=bool))

    def __len__(self) -> int:
        return len(self.doc)

    def take(self, keep: np.ndarray) -> "SuffixArray":
        """Those samples for which ``keep`` is true; the orders stay."""
        new = np.cumsum(keep) - 1
        fields = (x[keep] for x in (self.doc, self.at, self.low, self.high, self.behind, self.before, self.lost))
        return SuffixArray(*fields, *(new[by[keep[by]]] for by in (self.by_behind, self.by_before)))

    def merged(self, other: "SuffixArray") -> tuple["SuffixArray", np.ndarray]:
        """Both as one, and the place of each sample of the two in it: sorted runs are merged."""
        both = [np.concatenate([getattr(self, f), getattr(other, f)]) for f in ("doc", "at", "low", "high", "behind", "before", "lost")]
        order = np.lexsort((both[1], both[0]))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        orders = []
        for by, text in (("by_behind", both[4]), ("by_before", both[5])):
            runs = np.concatenate([getattr(self, by), getattr(other, by) + len(self)])
            orders.append(place[runs[np.argsort(text[runs], kind="stable")]])
        return SuffixArray(*(x[order] for x in both), *orders), place

    def scan(self) -> None:
        """Marks every string that starts earlier in another sample (or the same text)."""
        n, length = len(self), self.behind.dtype.itemsize
        if n < 2:
            return
        behind, before = _common(self.behind[self.by_behind]), _common(self.before[self.by_before])
        same = np.concatenate([[0], (self.doc[1:] != self.doc[:-1]) | (self.at[1:] != self.at[:-1])]).cumsum()
        a, b = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
        for d in range(self.lost.shape[1]):
            a[self.by_behind] = np.cumsum(behind < length - d)
            b[self.by_before] = np.cumsum(before < d)
            use = np.flatnonzero((self.low <= d) & (self.high >= d))
            kind = a[use] * (n + 1) + b[use]
            order = np.argsort(kind, kind="stable")  # the earliest of a kind comes first
            kind, use = kind[order], use[order]
            lead = np.maximum.accumulate(np.where(np.concatenate([[True], kind[1:] != kind[:-1]])[: len(kind)], np.arange(len(kind)), 0))
            later = same[use] != same[use[lead]]
            self.lost[use[later], d] = True

    def ranges(self) -> np.ndarray:
        """What the lost strings cover: a range for every run of them."""
        length = self.behind.dtype.itemsize
        edge = np.diff(np.pad(self.lost, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        sample, first = np.nonzero(edge == 1)
        _, last = np.nonzero(edge == -1)
        return _joined(self.doc[sample], self.at[sample] - (last - 1), self.at[sample] - first + length)

    def spent(self) -> np.ndarray:
        """Samples without a string of their own; an earlier sample has each of them."""
        return self.lost.sum(axis=1) == self.high - self.low + 1


class Family:
    """Suffix arrays in levels that grow geometrically; ``ranges`` gathers what samples that left have lost."""

    def __init__(self) -> None:
        self.levels: list[SuffixArray] = []
        self.ranges: list[np.ndarray] = []

    def _drop(self, level: SuffixArray) -> SuffixArray:
        gone = level.spent()
        if gone.any():
            self.ranges.append(level.take(gone).ranges())
            level = level.take(~gone)
        return level

    def add(self, batch: SuffixArray) -> None:
        """Scans a batch in itself and against every level, and makes it a level."""
        batch.scan()
        batch = self._drop(batch)
        # samples whose prefixes begin differently share no string
        begin = f"S{min(8, batch.behind.dtype.itemsize - batch.lost.shape[1] + 1)}"
        for i, level in enumerate(self.levels):
            near = np.isin(level.behind.astype(begin), batch.behind.astype(begin))
            both, place = level.take(near).merged(batch)
            both.scan()
            level.lost[near] |= both.lost[place[: near.sum()]]
            batch.lost |= both.lost[place[near.sum() :]]
            self.levels[i] = self._drop(level)
        self.levels.append(self._drop(batch))
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            self.levels[-2:] = [self.levels[-2].merged(self.levels[-1])[0]]

    def close(self) -> np.ndarray:
        """All ranges."""
        return np.concatenate([*self.ranges, *(level.ranges() for level in self.levels), np.zeros(0, dtype=RANGE)])


RANGE = np.dtype([("doc", "<i8"), ("start", "<i8"), ("end", "<i8")])


def _joined(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Ranges by document and start, those that touch made one."""
    order = np.lexsort((end, start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if len(doc):
        # the furthest end so far within each document, by a running maximum over shifted values
        rank = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
        span = int(end.max()) + 1
        reach = np.maximum.accumulate(end + rank * span) - rank * span
        at = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])]))
        doc, start, end = doc[at], start[at], reach[np.append(at[1:], len(doc)) - 1]
    out = np.empty(len(doc), dtype=RANGE)
    out["doc"], out["start"], out["end"] = doc, start, end
    return out


def _strings(head: np.ndarray, begin: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Surroundings as their strings, each the surroundings of itself."""
    count = head["size"] - length + 1
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    out = np.repeat(head, count)
    out["start"] += step
    out["at"] -= step.astype(np.int32)
    out["size"] = length
    return out, np.repeat(begin, count) + step


def _surroundings(documents: DataFrame, marks: np.ndarray, hot: np.ndarray, buckets: int, length: int, prefix: int) -> DataFrame:
    """(bucket, head, raw): packed marked samples; or, without a head, the ranges that a batch has settled itself."""
    sent = documents.sparkSession.sparkContext.broadcast((marks, hot))
    weights = mix(np.arange(1, length + 1, dtype=U64)) | U64(1)

    def part(data: np.ndarray, doc: np.ndarray, offsets: np.ndarray, s: Samples) -> tuple[np.ndarray, ...]:
        """Heads, raw bytes as rows, what tells them apart, and what deals them."""
        table, hot = sent.value
        spread = _spread(s.key)
        use = np.flatnonzero(_marked(table, spread))
        head, begin = np.empty(len(use), dtype=HEAD), s.first[use]
        head["doc"], head["start"] = doc[s.row[use]], begin - offsets[s.row[use]]
        head["size"], head["at"] = s.last[use] - begin + length, s.at[use] - begin
        deal, around = spread[use], s.around[use]
        at = np.minimum(np.searchsorted(hot, deal), max(0, len(hot) - 1))
        busy = hot[at] == deal if len(hot) else np.zeros(len(use), dtype=bool)
        if busy.any():
            each, start = _strings(head[busy], begin[busy], length)
            with np.errstate(over="ignore"):
                content = mix((data[start[:, None] + np.arange(length)] * weights).sum(axis=1, dtype=U64))
            head, begin = np.concatenate([head[~busy], each]), np.concatenate([begin[~busy], start])
            deal, around = np.concatenate([deal[~busy], content]), np.concatenate([around[~busy], content])
        return head, _rows_of(data, begin, head["size"], 2 * length - prefix), around, deal

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 2000):
            doc_ids = np.asarray(batch.column("doc_id"))
            found = [part(data, doc_ids[base:], offsets, s) for data, offsets, base, s in _batch_samples(batch.column("text"), length, prefix)]
            if not found:
                continue
            head, raw, around, deal = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((head["start"], head["doc"], around))
            h, bytes_ = head[order], raw[order]
            alike = (around[order][1:] == around[order][:-1]) & (h["size"][1:] == h["size"][:-1]) & (h["at"][1:] == h["at"][:-1])
            pair = np.flatnonzero(alike)
            alike[pair] = (bytes_[pair + 1] == bytes_[pair]).all(axis=1)
            same = np.concatenate([[False], alike])[: len(h)]
            lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(h)))) if len(h) else np.zeros(0, dtype=np.int64)
            settled = same & ((h["doc"] > h["doc"][lead]) | (h["start"] > h["start"][lead]))
            done = h[settled]
            ranges = _joined(done["doc"], done["start"], done["start"] + done["size"])
            order = order[~settled]
            bucket = (deal[order] % U64(buckets)).astype(np.int32)
            order = order[np.argsort(bucket, kind="stable")]
            bucket = np.sort(bucket)
            at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else bucket
            out: list[list] = [bucket[at].tolist(), [], []]
            inside = np.arange(raw.shape[1])
            for rows in np.split(order, at[1:]) if len(bucket) else []:
                out[1].append(head[rows].tobytes())
                out[2].append(raw[rows][inside < head["size"][rows, None]].tobytes())
            if len(ranges):
                for column, x in zip(out, (int(ranges["doc"][0] % buckets), None, ranges.tobytes()), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["bucket", "head", "raw"])

    return documents.mapInArrow(compute, "bucket int, head binary, raw binary")


def _repeats(length: int, prefix: int, buckets: int):
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, ranges = Family(), []
        heads, raws, waiting = [], [], 0
        for batch in batches:
            for head, raw in zip(batch.column("head"), batch.column("raw"), strict=True):
                if not head.is_valid:
                    ranges.append(np.frombuffer(raw.as_py(), dtype=RANGE))
                    continue
                heads.append(np.frombuffer(head.as_py(), dtype=HEAD))
                raws.append(np.frombuffer(raw.as_py(), dtype=np.uint8))
                waiting += len(raws[-1])
                if waiting >= BATCH:
                    index.add(SuffixArray.of(np.concatenate(heads), np.concatenate(raws), length, prefix))
                    heads, raws, waiting = [], [], 0
        if heads:
            index.add(SuffixArray.of(np.concatenate(heads), np.concatenate(raws), length, prefix))
        ranges.append(index.close())
        if ranges:
            found = np.concatenate(ranges)
            bucket = (mix(found["doc"].view(U64)) % U64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            at = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0])) if len(order) else order
            blobs = [found[rows].tobytes() for rows in np.split(order, at[1:])] if len(order) else []
            yield pa.RecordBatch.from_arrays([pa.array(bucket[order][at]), pa.array(blobs, pa.binary())], names=["bucket", "ranges"])

    return compute


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document: its ranges from all partitions, joined."""
    blobs = [np.frombuffer(r.as_py(), dtype=RANGE) for batch in batches for r in batch.column("ranges")]
    found = np.concatenate(blobs) if blobs else np.zeros(0, dtype=RANGE)
    r = _joined(*(np.ascontiguousarray(found[c]) for c in ("doc", "start", "end")))
    cut = np.flatnonzero(np.concatenate([[True], r["doc"][1:] != r["doc"][:-1]])) if len(r) else np.zeros(0, dtype=np.int64)
    offsets = pa.array(np.append(cut, len(r)), pa.int32())
    arrays = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(r[c]))) for c in ("start", "end")]
    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(r["doc"][cut])), *arrays], names=["doc_id", "starts", "ends"])


def removed_ranges(documents: DataFrame, length: int = LENGTH, prefix: int = PREFIX, mark_bits: int = MARK_BITS, buckets: int | None = None, hot: int = HOT) -> DataFrame:
    """(doc_id, starts, ends): byte ranges to remove, a row per document that loses any."""
    spark = documents.sparkSession
    documents = documents.where(F.col("doc_id").isNotNull())
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    marks, busy = _marks(documents, length, prefix, mark_bits, size, hot)
    buckets = buckets or max(partitions(spark), size // 8_000_000 + 1)
    # twice as many buckets as partitions even out what hashing deals
    dealt = _surroundings(documents, marks, busy, 2 * buckets, length, prefix)
    found = dealt.repartition(buckets, "bucket").mapInArrow(_repeats(length, prefix, buckets), "bucket int, ranges binary")
    return found.repartition(buckets, "bucket").mapInArrow(_by_document, "doc_id long, starts array<long>, ends array<long>")


def remove_repeats(documents: DataFrame, length: int = LENGTH, prefix: int = PREFIX, mark_bits: int = MARK_BITS, buckets: int | None = None, with_text: bool = False, hot: int = HOT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``with_text`` kept (binary).

    Removes each byte covered by a string of ``length`` bytes that also starts earlier: in a smaller
    doc_id, or earlier in the same document.  Overlaps count; strings are judged on the input.  A
    null text counts as empty; a null doc_id takes no part and loses nothing.  Rows of one doc_id
    are not earlier than each other at equal starts, and each loses what any of them repeats.
    """
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranges = removed_ranges(documents, length, prefix, mark_bits, buckets, hot)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            rows: list[tuple] = []
            for i, (starts, ends) in enumerate(zip(batch.column("starts"), batch.column("ends"), strict=True)):
                own = data[offsets[i] : offsets[i + 1]]
                removed = spans = 0
                if starts.is_valid and len(own):
                    change = np.zeros(len(own) + 1, dtype=np.int64)
                    np.add.at(change, np.minimum(np.asarray(starts.values), len(own)), 1)
                    np.add.at(change, np.minimum(np.asarray(ends.values), len(own)), -1)
                    gone = np.cumsum(change[:-1]) > 0
                    removed, spans = int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0])
                    own_kept = own[~gone].tobytes()
                else:
                    own_kept = own.tobytes()
                rows.append((len(own), removed, spans, hashlib.sha256(own_kept).hexdigest(), own_kept if with_text else None))
            n, removed, spans, digest, kept = zip(*rows, strict=True) if rows else ((),) * 5
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(kept, pa.binary())] if with_text else [])], names=names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return documents.join(ranges, "doc_id", "left").mapInArrow(apply, schema)
