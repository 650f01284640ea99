"""Periodic runs against a plain search of all stretches, and the lag counts on both sides of the threshold."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from inkscan.llm import bytesops, periods
from inkscan.llm.queries import ORACLES, QUERIES
from tests.llm.oracles import same


def stretches(w):
    """(start, length, period) of all runs: every maximal stretch of every lag whose smallest period is that lag."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            s = w[i : j + q]
            if j > i and len(s) >= max(6, 4 * q) and all(s[p:] != s[:-p] for p in range(1, q)):
                out.append((i, len(s), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute(doc_id, text, tails=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, c = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if tails and c % 10 == 0 and n:
        g = c // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = stretches(w)
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *best, sha("".join(f"{a},{length},{q}\n" for a, length, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def texts():
    draw = random.Random(11)
    out = [None, "", " \n", "a", "a " * 5, "a " * 6, "a b " * 4, "a b " * 3 + "a", "ab a b " * 6, "x y z " * 4 + "x y", "a a b " * 8 + "a a a a a a a", "é è é è " * 9, "a\tb\nc\x0bd\x0c" * 5]
    for _ in range(150):
        unit = draw.choices("abc", k=draw.randint(1, 6))
        words = draw.choices("abcd", k=draw.randint(0, 20)) + unit * draw.randint(1, 7) + unit[: draw.randint(0, 5)] + draw.choices("ab", k=draw.randint(0, 20))
        out.append(draw.choice([" ", "\n", "  "]).join(words))
    out += [" ".join(draw.choices(["the", "of", *map(str, range(40))], weights=[9, 9] + [1] * 40, k=700)) for _ in range(5)]
    return out


def test_against_brute_force(spark):
    rows = list(enumerate(texts())) + [(None, "a b " * 9), (3, "a b c " * 9), (3, "a b c " * 9)]
    df = spark.createDataFrame([(t, i, "x", 1) for i, t in rows], "text string, doc_id long, runs string, start int")
    for tails in (True, False):
        got = sorted(map(tuple, periods.periodic_runs(df, tails).drop("runs").collect()), key=repr)
        assert got == sorted((brute(i, t, tails) for i, t in rows), key=repr)
    assert periods.periodic_runs(df.limit(0)).collect() == []
    listed = {r.doc_id: [tuple(x) for x in r.runs] for r in periods.periodic_runs(df.where("doc_id = 10")).collect()}
    assert listed == {10: stretches(texts()[10].split())}


@pytest.mark.parametrize("least", [1, 3, 10**9])
def test_counts_are_exact_however_words_are_split(monkeypatch, least):
    """All words frequent, some, or none: the same counts at every lag, over several texts at once."""
    monkeypatch.setattr(periods, "heavy_from", lambda n: least)
    monkeypatch.setattr(periods, "HELD", 50)
    draw = np.random.default_rng(least % 97)
    sizes = [0, 1, 4, 37, 300, 5]
    code, first = draw.integers(0, 6, sum(sizes)), np.concatenate([[0], np.cumsum(sizes)])
    counts, base, most = periods.lag_counts(code, first)
    for r, n in enumerate(sizes):
        own = code[first[r] : first[r + 1]]
        assert most[r] == n // 4
        assert [int(x) for x in counts[base[r] + 1 : base[r + 1]]] == [int((own[q:] == own[:-q]).sum()) for q in range(1, n // 4 + 1)]


def test_a_long_text_with_frequent_words():
    """Twenty thousand words: transforms and differences both take part, and only planted runs come out."""
    draw = np.random.default_rng(5)
    code = np.where(draw.random(20_000) < 0.3, 0, draw.integers(1, 3000, 20_000))
    code[4000:9000] = np.resize(draw.permutation(3000)[:1000] + 1, 5000)
    code[15_000:15_007] = 5
    runs = periods.find(code, np.array([0, len(code)]))
    assert set(zip(runs.start.tolist(), runs.length.tolist(), runs.period.tolist(), strict=True)) >= {(4000, 5000, 1000), (15_000, 7, 1)}
    assert (np.bincount(code).max() > periods.heavy_from(len(code))) and len(runs.row) < 40


def test_words_in_blocks():
    """Blocks that end at white space give the same words as one pass, also in words longer than a block."""
    data = np.frombuffer(("ab  c\n" * 50 + "x" * 500 + " end\té " * 30 + "y" * 99).encode(), dtype=np.uint8)
    offsets = np.array([0, 0, 7, 100, 100, len(data)])
    whole = bytesops.Words(data, offsets)
    want = bytesops.SliceHash(data)(whole.starts, whole.ends)
    for block in (1, 16, 100, 10**6):
        starts, ends, hashes, first = bytesops.word_places(data, offsets, block)
        assert starts.tolist() == whole.starts.tolist() and ends.tolist() == whole.ends.tolist()
        assert hashes.tolist() == want.tolist() and first.tolist() == whole.first.tolist()


def test_query(spark):
    assert sum(r[0] is not None for r in same(spark, QUERIES["op13_periods"], ORACLES["op13_periods"])) == 1000
