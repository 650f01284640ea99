"""Periodic runs of words: heavy and light lag counting, then scans of the lags that can hold a run.

A run of period q is a stretch of words that equal those q places on.  How many places of a text
match at each lag is counted exactly: a word that occurs rarely gives the differences of its places,
a frequent one the autocorrelation of its places, of which all are added up before one inverse
Fourier transform per text.  A run of period q holds at least 3q matches at lag q, so only lags with that many
are scanned for islands of matches.  An island whose stretch has a smaller period, which then divides q,
is no run of q.

A text is worked on where it lies, in one task: differences of one word within a quarter of the text,
and arrays of a few numbers per word.  Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkscan.llm.bytesops import give_back, pieces, text_bytes, word_places
from inkscan.llm.shared import small_batches

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Differences that are held before they are counted; kept words whose bytes are gathered at once.
HELD, GATHERED = 1 << 20, 1 << 17


def needed(lag: np.ndarray) -> np.ndarray:
    """Matches in a row that a run of this period has at least."""
    return np.maximum(LEAST_WORDS - lag, (LEAST_PERIODS - 1) * lag)


def heavy_from(n_words: int) -> int:
    """A word of more occurrences in a text of ``n_words`` is frequent: its transform then costs less than its differences."""
    return max(64, int(0.4 * sqrt(n_words * log2(max(2, n_words)))))


def _rare(row: np.ndarray, place: np.ndarray, group: np.ndarray, most: np.ndarray, base: np.ndarray, counts: np.ndarray) -> None:
    """Adds the differences of equal words of ``group``s to ``counts``; places ascend within a group."""
    held, size = [], 0
    alive, step = np.arange(len(place)), 0
    while len(alive):
        step += 1
        alive = alive[: np.searchsorted(alive, len(place) - step)]
        lag = place[alive + step] - place[alive]
        # places ascend: who is too far from this one is too far from all that follow
        near = (group[alive + step] == group[alive]) & (lag <= most[row[alive]])
        alive, lag = alive[near], lag[near]
        held.append(base[row[alive]] + lag)
        size += len(lag)
        if size > HELD:
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
            held, size = [], 0
    if held:
        counts += np.bincount(np.concatenate(held), minlength=len(counts))


def _frequent(places: list[np.ndarray], n: int, most: int) -> np.ndarray:
    """Matches at lags 0..most that the words at ``places`` give; sums of whole numbers far below 2**53, so rounding is exact."""
    size = 1
    while size < n + most:
        size *= 2
    size = size * 3 // 4 if size * 3 // 4 >= n + most and size >= 4 else size
    power = np.zeros(size // 2 + 1)
    for p in places:
        mark = np.zeros(size)
        mark[p] = 1
        f = np.fft.rfft(mark)
        power += f.real**2 + f.imag**2
    return np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)


def lag_counts(code: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches at every lag of every row of words: (counts, where each row's begin, its greatest lag)."""
    sizes = np.diff(first)
    most = sizes // LEAST_PERIODS
    base = np.concatenate([[0], np.cumsum(most + 1)]).astype(np.int64)
    counts = np.zeros(base[-1], dtype=np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    key = row * (int(code.max()) + 1 if len(code) else 1) + code
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    often = np.diff(np.append(new, len(key)))
    limit = np.array([heavy_from(int(n)) for n in sizes], dtype=np.int64)
    heavy = often > limit[row[order[new]]] if len(new) else np.zeros(0, dtype=bool)
    group = np.repeat(np.arange(len(new)), often)
    light = order[~heavy[group]] if len(new) else order
    _rare(row[light], light - first[row[light]], group[~heavy[group]] if len(new) else group, most, base, counts)
    by_row: dict[int, list[np.ndarray]] = {}
    for g in np.flatnonzero(heavy):
        own = order[new[g] : new[g] + often[g]]
        by_row.setdefault(int(row[own[0]]), []).append(own - first[row[own[0]]])
    for r, places in by_row.items():
        counts[base[r] : base[r + 1]] += _frequent(places, int(sizes[r]), int(most[r]))
    return counts, base, most


def prime_divisors(q: int) -> list[int]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return out + ([q] if q > 1 else [])


def islands(code: np.ndarray, lag: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches of one text that have ``lag`` as their smallest period and are long enough."""
    same = np.concatenate([[False], code[lag:] == code[:-lag], [False]])
    edges = np.flatnonzero(same[1:] != same[:-1])
    begin, end = edges[::2], edges[1::2]
    long = end - begin >= needed(np.int64(lag))
    out = []
    for a, e in zip(begin[long].tolist(), (end[long] + lag).tolist(), strict=True):
        if not any(np.array_equal(code[a : e - lag // p], code[a + lag // p : e]) for p in prime_divisors(lag)):
            out.append((a, e))
    return out


@dataclass
class Runs:
    """The runs of a batch: row, start, length and period, in the order of rows, starts and periods."""

    row: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def find(code: np.ndarray, first: np.ndarray) -> Runs:
    """All runs of rows of words; ``code`` tells words apart, ``first`` where each row's begin (and the end)."""
    counts, base, most = lag_counts(code, first)
    lag = np.arange(len(counts)) - np.repeat(base[:-1], most + 1)
    some = np.flatnonzero((lag > 0) & (counts >= needed(lag)))
    rows = np.searchsorted(base, some, side="right") - 1
    found = [(r, a, e - a, q) for r, q in zip(rows.tolist(), lag[some].tolist(), strict=True) for a, e in islands(code[first[r] : first[r + 1]], q)]
    found.sort(key=lambda x: (x[0], x[1], x[3]))
    return Runs(*(np.array(c, dtype=np.int64) for c in zip(*found, strict=True))) if found else Runs(*(np.zeros(0, dtype=np.int64) for _ in range(4)))


def planted(first: np.ndarray, checksum: np.ndarray) -> np.ndarray:
    """For every word the word that stands in its place: itself, but for the periodic tails of one text in ten."""
    out = np.arange(first[-1])
    for r in np.flatnonzero((checksum >= 0) & (checksum % 10 == 0) & (np.diff(first) > 0)):
        n, g = int(first[r + 1] - first[r]), int(checksum[r]) // 10
        a = g % n
        out[first[r] + a : first[r + 1]] = first[r] + a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return out


def without_repeats(runs: Runs, first: np.ndarray) -> np.ndarray:
    """Which words stay: none that a run holds after its first period."""
    change = np.zeros(int(first[-1]) + 1, dtype=np.int64)
    np.add.at(change, first[runs.row] + runs.start + runs.period, 1)
    np.add.at(change, first[runs.row] + runs.start + runs.length, -1)
    return np.cumsum(change)[:-1] == 0


def _digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kept: np.ndarray, first: np.ndarray) -> list[str]:
    """The digest of each row's words ``kept`` (indices into starts and ends, row after row), joined by one space."""
    hashers = [hashlib.sha256() for _ in range(len(first) - 1)]
    for i in range(0, len(kept), GATHERED):
        at = kept[i : i + GATHERED]
        length = ends[at] - starts[at] + 1
        stop = np.cumsum(length)
        index = np.arange(int(stop[-1])) + np.repeat(starts[at] - (stop - length), length)
        index[stop - 1] = 0
        out = data[index]
        out[stop - 1] = 32
        stop = np.concatenate([[0], stop])
        for r in range(int(np.searchsorted(first, i, side="right")) - 1, len(hashers)):
            a, b = max(int(first[r]), i), min(int(first[r + 1]), i + len(at))
            if first[r] >= i + len(at):
                break
            if a < b:  # a row's last word has no space behind it
                hashers[r].update(out[stop[a - i] : stop[b - i] - (b == first[r + 1])])
    return [h.hexdigest() for h in hashers]


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _batch(ids: pa.Array, checksum: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    n = len(offsets) - 1
    starts, ends, hashes, first = word_places(data, offsets)
    source = planted(first, checksum)
    code = np.unique(hashes, return_inverse=True)[1][source]
    runs = find(code, first)
    stay = np.flatnonzero(without_repeats(runs, first))
    collapsed = _digests(data, starts, ends, source[stay], np.searchsorted(stay, first))
    at = np.searchsorted(runs.row, np.arange(n + 1))
    best: list[tuple[int | None, ...]] = []
    said, listed = [], []
    for r in range(n):
        own = list(zip(*(c[at[r] : at[r + 1]].tolist() for c in (runs.start, runs.length, runs.period)), strict=True))
        a, length, q = min(own, key=lambda x: (-x[1], x[0], x[2])) if own else (None, None, None)
        best.append((len(own), a, length, q, 1000 * length // q if own else None))
        said.append(hashlib.sha256("".join(f"{a},{length},{q}\n" for a, length, q in own).encode()).hexdigest())
        listed.append([{"start": a, "length": length, "period": q} for a, length, q in own])
    columns = [pa.array(c, pa.int64()) for c in zip(*best, strict=True)] if best else [pa.array([], pa.int64())] * 5
    return pa.RecordBatch.from_arrays([ids, *columns, pa.array(said, pa.string()), pa.array(collapsed, pa.string()), pa.array(listed, _RUN)], names=[c.split()[0] for c in SCHEMA.split(", ")])


def periodic_runs(documents: DataFrame, tails: bool = False) -> DataFrame:
    """Per document: doc_id, n_runs, the longest run (start, length, period, exponent_milli), runs_sha256, collapsed_sha256, runs.

    Words are told apart by hashes of 62 bits.  With ``tails`` one text in ten, by the checksum of its
    id, is read with a periodic tail.  Of longest runs the first counts, then that of the least period;
    a null or empty text has no run, four nulls and the digests of nothing.  Every input row gives a row;
    a null id gets no tail; other columns are ignored.  A text is held in one task, with some 60 bytes per word and its
    transforms; counting takes about the power 1.5 of its words.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            checksum = batch.column("checksum").to_numpy(zero_copy_only=False)
            for a, b in pieces(offsets):
                yield _batch(batch.column("doc_id").slice(a, b - a), checksum[a:b], data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        give_back()

    small_batches(documents.sparkSession)
    checksum = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(-1)) if tails else F.lit(-1)
    df = documents.select(F.col("doc_id").cast("long").alias("doc_id"), checksum.cast("long").alias("checksum"), F.col("text").cast("string").alias("text"))
    return df.mapInArrow(scan, SCHEMA)
