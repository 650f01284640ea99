import random
import re

import numpy as np
import pyarrow as pa
import pytest

from inkscan.llm import jaccard


def brute(rows):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    least = [d for d, _ in rows]
    holders = {}
    for i, s in enumerate(sets):
        for t in s:
            holders.setdefault(t, []).append(i)
    pairs = set()
    for i, s in enumerate(sets):
        shared = {}
        for t in s:
            for j in holders[t]:
                if j > i:
                    shared[j] = shared.get(j, 0) + 1
        pairs |= {(i, j) for j, n in shared.items() if 100 * n >= 75 * (len(s) + len(sets[j]) - n)}
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            if least[i] != least[j]:
                least[i] = least[j] = min(least[i], least[j])
                changed = True
    return sorted((d, len(s), c) for (d, _), s, c in zip(rows, sets, least, strict=True))


def check(spark, rows, **how):
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, fp int")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_copies(df, **how).collect())
    assert got == brute(rows)


def varied(seed, groups, most, length):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = draw.choices(vocabulary, k=40)
    rows = []
    for _ in range(groups):
        base = draw.choices(vocabulary, k=draw.randint(6, length))
        for _ in range(draw.randint(1, most)):
            words = list(base)
            for _ in range(draw.randint(0, 3)):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
            if draw.random() < 0.3:
                words[3:3] = passage
            rows.append(" ".join(words))
    rows += [None, "", " \n", "one", "one", "ONE", "one two", "a b c d e", "A b C d e", "a b c d", "a b c d e f", "x " * 5000]
    draw.shuffle(rows)
    return [(i * 7 % 1000003, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("bits", [20, 18])
def test_as_brute_force(spark, bits):
    check(spark, varied(bits, 60, 8, 90), sketch_bits=bits)


@pytest.mark.parametrize("hot", [1 << 30, 12])
def test_large_groups_of_near_copies(spark, monkeypatch, hot):
    monkeypatch.setattr(jaccard, "LONG_LIST", 6)
    monkeypatch.setattr(jaccard, "CHUNK", 16)
    check(spark, varied(3, 4, 120, 60), sketch_bits=18, hot=hot)


def test_a_chain_of_links(spark, monkeypatch):
    """Neighbours link, the ends don't: no few sets of the cluster show that it is one component."""
    monkeypatch.setattr(jaccard, "CHUNK", 4)
    words = [f"w{i}" for i in range(160)]
    rows = [(i, " ".join(words[i : i + 60])) for i in range(0, 90, 3)]
    check(spark, rows + [(1000 + i, " ".join(words[i + 1 : i + 61])) for i in range(0, 30, 7)], sketch_bits=18, hot=5)


def test_long_words_of_two_letters(spark):
    """Words that a polynomial modulo a power of two can't tell apart."""
    def thue_morse(k, a, b):
        s = a
        for _ in range(k):
            s += s.translate(str.maketrans(a + b, b + a))
        return s

    rows = [(10 * k + i, thue_morse(k, *x)) for k in (10, 11, 12, 13) for i, x in enumerate(("ab", "ba"))]
    check(spark, rows, sketch_bits=18)


def test_repeated_rows_and_none(spark):
    check(spark, [(5, "a b c d e f g"), (5, "a b c d e f g"), (2, "a b c d e f g"), (9, "a b c d e f g h")], sketch_bits=18)
    check(spark, [], sketch_bits=18)


def test_derived_overlaps():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 60, 80, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(80) < 0.9], rng.integers(0, 1 << 60, 4, dtype=np.uint64)])) for _ in range(60)]
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if 100 * (n := len(np.intersect1d(sets[i], sets[j]))) >= 75 * (len(sets[i]) + len(sets[j]) - n)}
    assert set(zip(*map(np.ndarray.tolist, jaccard.links(sets)), strict=True)) == want and 0 < len(want) < 1770
    assert set(zip(*map(np.ndarray.tolist, jaccard.links(sets, 20)), strict=True)) == {(i, j) for i, j in want if i < 20 <= j}


def test_driver_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_copies(df).collect()) == brute(rows)


def test_long_texts_in_blocks(spark):
    """The sets of a text don't depend on the blocks it is hashed in, whatever stands at their borders."""
    draw = random.Random(5)
    texts = [" ".join(draw.choices(["a", "Bc", "d" * 70, "é"], k=draw.randint(0, 60))) + draw.choice(["", " ", "\n"]) for _ in range(40)]
    column = pa.array([None, "", *texts, "x" * 500])
    whole = list(jaccard.shingle_sets(column))
    for block in (1, 16, 64, 1000):
        parts = list(jaccard.shingle_sets(column, block))
        assert [i for i, _ in parts] == [i for i, _ in whole] and all(np.array_equal(a, b) for (_, a), (_, b) in zip(parts, whole, strict=True))
    long = " ".join(f"w{i}" for i in range(700_000))
    rows = [(1, long), (2, long + " end"), (3, "other " + long[: len(long) // 2])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), sketch_bits=18).collect()}
    assert got[1] == (699_996, 1) and got[2] == (699_997, 1) and got[3][1] == 3
