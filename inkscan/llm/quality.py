"""Quality rules: boosted trees over document statistics, scored as flat numpy node arrays.

Statistics of all documents are computed in tasks from the texts' bytes.  The trees are fitted on
a bounded sample of labelled documents (``MAX_LABELLED``, chosen by a hash of the id), with
monotone constraints: the score never rises with symbols, repeated lines or repeated words.  A
fitted ensemble is five flat arrays; all rows of a batch walk one level of all trees at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkscan.llm.bytesops import IS_SPACE, SliceHash, Words, give_back, pieces, shingles, text_bytes
from inkscan.llm.shared import small_batches

#: The fit reads at most this many labelled documents.
MAX_LABELLED = 20_000
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
#: A document stays if its predicted probability of good quality is at least this.
KEEP_AT = 0.5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_points", "n_lines", "n_digits", "n_upper", "n_stops", "n_distinct")
STATS = ", ".join(f"{c} long" for c in (*COUNTS, *MORE))

_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[list(b"#*$%&|<>")] = True
_KIND = np.zeros(256, dtype=np.int8)
_KIND[ord("0") : ord("9") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[list(b".!?")] = 3


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeats(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal (row, hash) pairs: whether another exists, and whether one stands earlier."""
    order = np.lexsort((hashes, rows))  # stable, so equal pairs keep their order in the text
    same = (rows[order][1:] == rows[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    later = np.concatenate([[False], same])
    again, earlier = np.zeros(len(rows), dtype=bool), np.zeros(len(rows), dtype=bool)
    again[order] = later | np.concatenate([same, [False]]) if len(rows) else later[:0]
    earlier[order] = later[: len(rows)]
    return again, earlier


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Every statistic of every text of a batch."""
    n, words = len(offsets) - 1, Words(data, offsets)
    slices = SliceHash(data)
    hashes = slices(words.starts, words.ends)
    lead = (data & 0xC0) != 0x80
    out = {
        "n_words": np.diff(words.first),
        "word_chars": _per_row(lead & ~IS_SPACE[data], offsets),
        "n_symbols": _per_row(_IS_SYMBOL[data], offsets),
        "n_points": _per_row(lead, offsets),
        "n_digits": _per_row(_KIND[data] == 1, offsets),
        "n_upper": _per_row(_KIND[data] == 2, offsets),
        "n_stops": _per_row(_KIND[data] == 3, offsets),
    }
    # lines that hold a word: from a text's start or after a \n, to the next \n or the text's end
    breaks = np.flatnonzero(data == 10)
    starts = np.union1d(breaks + 1, offsets[:-1])
    starts = starts[starts < len(data)]
    rows = np.searchsorted(offsets, starts, side="right") - 1
    ends = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, starts)], offsets[rows + 1])
    solid = np.concatenate([[0], np.cumsum(~IS_SPACE[data])])
    held = solid[ends] > solid[starts]
    starts, ends, rows = starts[held], ends[held], rows[held]
    _, earlier = _repeats(rows, slices(starts, ends))
    out["n_lines"] = np.bincount(rows, minlength=n)
    out["n_dup_lines"] = np.bincount(rows[earlier], minlength=n)
    # five-word windows; those of shorter texts can't repeat
    found, first = shingles(hashes, words.first)
    rows = np.repeat(np.arange(n), np.diff(first))
    again, _ = _repeats(rows, found)
    again &= np.diff(words.first)[rows] >= 5
    at = words.first[rows] + np.arange(len(rows)) - first[rows]
    change = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(change, at[again], 1)
    np.add.at(change, at[again] + 5, -1)
    out["n_repeat_words"] = _per_row(np.cumsum(change)[:-1] > 0, words.first)
    rows = words.rows
    _, earlier = _repeats(rows, hashes)
    out["n_distinct"] = np.bincount(rows[~earlier], minlength=n)
    return {k: v.astype(np.int64) for k, v in out.items()}


def with_statistics(documents: DataFrame, keep: list[str]) -> DataFrame:
    """``documents``' columns ``keep`` and the statistics of their whole texts (null: as empty)."""
    names = [*COUNTS, *MORE]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("__text"))
            parts = [statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in pieces(offsets)]
            found = [pa.array(np.concatenate([p[name] for p in parts]) if parts else np.zeros(0, dtype=np.int64)) for name in names]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *found], names=[*keep, *names])
        give_back()

    small_batches(documents.sparkSession)
    df = documents.select(*keep, F.col("text").cast("string").alias("__text"))
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), STATS])
    return df.mapInArrow(compute, schema)


#: Features as rates, and the direction in which each may move the score (-1: more is never better).
FEATURES: dict[str, int] = {
    "log_words": 0, "chars_per_word": 0, "symbols_per_char": -1, "dup_line_share": -1, "repeat_share": -1,
    "digits_per_char": 0, "upper_per_char": 0, "stops_per_word": 0, "distinct_share": 0, "words_per_line": 0,
}


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    s = {k: np.asarray(v, dtype=np.float64) for k, v in s.items()}
    words, chars, lines = (np.maximum(s[k], 1) for k in ("n_words", "n_points", "n_lines"))
    return np.stack([
        np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / chars, s["n_dup_lines"] / lines, s["n_repeat_words"] / words,
        s["n_digits"] / chars, s["n_upper"] / chars, s["n_stops"] / words, s["n_distinct"] / words, s["n_words"] / lines,
    ], axis=1)


@dataclass(frozen=True)
class Trees:
    """An ensemble as node arrays, tree after tree; a leaf points at itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability per row of ``x``: all rows walk all trees, one level at a time."""
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 64, l2: float = 1.0, least: int = 20) -> Trees:
    """Gradient-boosted trees for log loss on binned features.

    A split that would break a feature's direction is not taken, and the children of a split on
    a constrained feature get the midpoint of their values as a bound.
    """
    if not len(y) or y.min() == y.max():  # nothing to tell apart
        p = (y.sum() + 1) / (len(y) + 2)
        one = np.zeros(1, dtype=np.int64)
        return Trees(one, np.zeros(1), one, one, np.zeros(1), one, 0, float(np.log(p / (1 - p))))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    z = np.full(len(y), base)
    nodes: list[list[float]] = []
    roots: list[int] = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)

        def grow(rows: np.ndarray, left: int, low: float, high: float) -> int:
            me, gs, hs = len(nodes), g[rows].sum(), h[rows].sum()
            value = float(np.clip(gs / (hs + l2), low, high))
            nodes.append([0, 0.0, me, me, value * rate])
            best = (1e-6, None)
            if left and len(rows) >= 2 * least:
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    gl = np.cumsum(np.bincount(binned[rows, j], g[rows], len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[rows, j], h[rows], len(c) + 1))[:-1]
                    nl = np.cumsum(np.bincount(binned[rows, j], minlength=len(c) + 1))[:-1]
                    vl, vr = np.clip(gl / (hl + l2), low, high), np.clip((gs - gl) / (hs - hl + l2), low, high)
                    gain = gl * vl - 0.5 * (hl + l2) * vl**2 + (gs - gl) * vr - 0.5 * (hs - hl + l2) * vr**2 - (gs * value - 0.5 * (hs + l2) * value**2)
                    gain[(nl < least) | (len(rows) - nl < least) | ((vr - vl) * monotone[j] < 0)] = -1
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (float(gain[k]), (j, k, float(vl[k]), float(vr[k])))
            if best[1] is None:
                z[rows] += value * rate
                return me
            j, k, vl, vr = best[1]
            middle, goes_left = (vl + vr) / 2, binned[rows, j] <= k
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[monotone[j]]
            nodes[me][:2] = [j, float(cuts[j][k])]
            nodes[me][2] = grow(rows[goes_left], left - 1, *bounds[0])
            nodes[me][3] = grow(rows[~goes_left], left - 1, *bounds[1])
            return me

        roots.append(grow(np.arange(len(y)), depth, -4.0, 4.0))
    a = np.array(nodes)
    return Trees(a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4], np.array(roots), depth, base)


def train(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Trees:
    """Trees fitted on at most ``most`` labelled documents, those of the least hashes of their ids."""
    chosen = (
        labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    some = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``most`` ids
    table = with_statistics(some, ["doc_id", "quality"]).groupBy("doc_id").agg(*(F.max(c).alias(c) for c in ("quality", *COUNTS, *MORE))).toArrow()
    order = np.argsort(table.column("doc_id").to_numpy(), kind="stable")
    stats = {c: table.column(c).to_numpy()[order] for c in (*COUNTS, *MORE)}
    return fit(features(stats), table.column("quality").to_numpy()[order].astype(np.float64), list(FEATURES.values()))


def judge(documents: DataFrame, trees: Trees, keep: list[str], keep_at: float = KEEP_AT) -> DataFrame:
    """``keep``, the statistics, base_failed, quality_score and kept, for every document.

    Base rules: fewer than 10 words, or over 20 % of them in repeated five-word windows.  A null
    text counts as empty and so fails; repeated rows are judged each; without any labels the
    trees are a constant that keeps what the base rules pass.
    """
    names = [*COUNTS, *MORE]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features({c: batch.column(c).to_numpy() for c in names})
            found = np.concatenate([trees.score(x[i : i + 4096]) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "quality_score"])

    df = with_statistics(documents, keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", quality_score double"
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    scored = df.mapInArrow(score, schema).withColumn("base_failed", failed)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("quality_score") >= keep_at))
