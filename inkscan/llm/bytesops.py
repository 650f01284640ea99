"""Vectorised work on the UTF-8 bytes of a batch of texts, for use inside tasks.

A batch is one ``uint8`` array and the byte offsets of its texts.  A substring is
hashed from prefix sums of two polynomials modulo primes, so the hash of any slice
costs O(1) after one pass over the bytes.
"""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Two primes and a base for each.  Modulo a power of two, long strings of few letters would collide for every base.
FIELDS = ((2147483647, 1358007413), (2147483629, 912345679))
SHINGLE_WEIGHTS = np.array(
    [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=U64
)

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, prime: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo the prime; the longest asked for stays in the worker."""
    have = _powers.get((base, prime))
    if have is None or len(have) < n:
        have = np.ones(1, dtype=np.uint32)
        while len(have) < max(n, 1 << 19):
            have = np.concatenate([have, (have * U64(pow(base, len(have), prime)) % U64(prime)).astype(np.uint32)])
        _powers[base, prime] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTES = mix(np.arange(256, dtype=U64) + U64(0x9E3779B97F4A7C15))


class SliceHash:
    """Hashes of slices of ``data``, of 62 bits; equal bytes give equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.lanes = []
        for prime, base in FIELDS:
            sums = np.zeros(n + 1, dtype=U64)
            terms = (data.astype(U64) + U64(1)) * powers(base, prime, n)
            # 2**24 terms of under 2**40 fit in 64 bits as they are
            np.cumsum(terms if n < 1 << 24 else terms % U64(prime), dtype=U64, out=sums[1:])
            self.lanes.append((sums, powers(pow(base, -1, prime), prime, n + 1), U64(prime)))

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        a, b = ((sums[ends] - sums[starts]) % prime * inverse[starts] % prime for sums, inverse, prime in self.lanes)
        return mix(a << U64(32) | b)


def window_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of every slice of k bytes, in order; for slices too short to collide by their structure."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    # widths 1, 2, 4, ...: two neighbours make one of twice the width; what is left overlaps
    with np.errstate(over="ignore"):
        h, width, factor = _BYTES[data], 1, U64(0x9FB21C651E98DF25)
        while width < k:
            step = min(width, k - width)
            h = h[: len(h) - step] * factor + h[step:]
            width, factor = width + step, factor * U64(0xD6E8FEB86659FD93)
        return mix(h)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so what a task makes of a batch stays small."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def give_back() -> None:
    """Hands freed memory back to the system at a task's end: workers live on, and the next stage needs theirs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def pieces(offsets: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer text is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


class Words:
    """Where the words ``[^\\x20\\x09-\\x0D]+`` of a batch stand; rows: their text's index."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        solid = ~IS_SPACE[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        before = np.zeros(len(data), dtype=bool)
        before[1:] = solid[:-1]
        after = np.zeros(len(data), dtype=bool)
        after[:-1] = solid[1:]
        self.starts = np.flatnonzero(solid & (~before | edge[:-1]))
        self.ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.rows = np.searchsorted(offsets, self.starts, side="right") - 1
        self.first = np.searchsorted(self.rows, np.arange(len(offsets)))  # of each row, and the end


def shingles(word_hashes: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows, row after row, and where each row's begin (and the end).

    A row of fewer words has the whole sequence as its one shingle; a row without words none.
    """
    counts = np.diff(first)
    per_row = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    at = np.concatenate([[0], np.cumsum(per_row)]).astype(np.int64)
    out = np.zeros(at[-1], dtype=U64)
    long_rows = np.flatnonzero(counts >= k)
    with np.errstate(over="ignore"):
        if len(long_rows):
            begin = np.repeat(first[long_rows], per_row[long_rows])
            step = np.arange(len(begin)) - np.repeat(np.cumsum(per_row[long_rows]) - per_row[long_rows], per_row[long_rows])
            word = begin + step
            total = np.zeros(len(word), dtype=U64)
            for j in range(k):
                total += word_hashes[word + j] * SHINGLE_WEIGHTS[j % 5] * U64(2 * (j // 5) + 1)
            out[np.repeat(at[:-1][long_rows], per_row[long_rows]) + step] = mix(total)
        for n in range(1, k):
            rows = np.flatnonzero(counts == n)
            if len(rows):
                total = np.full(len(rows), n, dtype=U64)  # the length tells a short text from a window
                for j in range(n):
                    total += word_hashes[first[rows] + j] * SHINGLE_WEIGHTS[j % 5] * U64(2 * (j // 5) + 1)
                out[at[:-1][rows]] = mix(total ^ U64(0x5851F42D4C957F2D))
    return out, at


def minimum_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each node's component, for edges between nodes 0..n-1."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:  # point at roots
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def word_places(data: np.ndarray, offsets: np.ndarray, block: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of a batch, and where each row's words begin (and the end).

    The bytes are worked on in blocks that end at white space, so the arrays that live on hold a few
    numbers per word and not tens of bytes per byte, however long a text is; a longer word is a block.
    """
    parts, at, n = [], 0, len(data)
    while at < n:
        end = min(n, at + block)
        while end < n and not IS_SPACE[data[end]]:
            ahead = np.flatnonzero(IS_SPACE[data[end : end + block]])
            end = end + int(ahead[0]) if len(ahead) else min(n, end + block)
        inner = offsets[(offsets > at) & (offsets < end)]
        w = Words(data[at:end], np.concatenate([[at], inner, [end]]) - at)
        parts.append((w.starts + at, w.ends + at, SliceHash(data[at:end])(w.starts, w.ends)))
        at = end
    starts, ends, hashes = (np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64))
    return starts, ends, hashes, np.searchsorted(starts, offsets)
