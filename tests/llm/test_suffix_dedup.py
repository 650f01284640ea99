import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from inkscan.llm import suffix_dedup
from inkscan.llm.bytesops import text_bytes


def brute(rows, length):
    first = {}
    raw = [(d, (t or "").encode()) for d, t in rows]
    for d, t in raw:
        for s in range(len(t) - length + 1):
            k = t[s : s + length]
            first[k] = min(first.get(k, (d, s)), (d, s))
    out = []
    for d, t in raw:
        gone = np.zeros(len(t), dtype=bool)
        for s in range(len(t) - length + 1):
            if first[t[s : s + length]] < (d, s):
                gone[s : s + length] = True
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(bool(gone[i] and (i == 0 or not gone[i - 1])) for i in range(len(t)))
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def varied(seed, n, size):
    draw = random.Random(seed)
    letters = "abcdé 🚀\n"
    passages = ["".join(draw.choices(letters, k=draw.randint(10, 90))) for _ in range(6)]
    rows = []
    for _ in range(n):
        t = ""
        while len(t) < draw.randint(0, size):
            t += draw.choice([draw.choice(passages), "".join(draw.choices(letters, k=draw.randint(1, 40))), "z" * draw.randint(0, 60)])
        rows.append(t)
    rows += [None, "", "a" * 400, "a" * 99, "a" * 101, "ab" * 150, rows[0], rows[0], rows[1]]
    draw.shuffle(rows)
    return [(i * 13 % 10007, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("length,prefix,seed,hot", [(20, 8, 1, 9), (20, 20, 2, 1 << 30), (33, 10, 3, 5), (100, 32, 4, 1 << 30), (100, 32, 5, 3)])
def test_as_brute_force(spark, monkeypatch, length, prefix, seed, hot):
    monkeypatch.setattr(suffix_dedup, "BATCH", 2000)
    rows = varied(seed, 60, 400)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, bucket int").repartition(5)
    got = suffix_dedup.remove_repeats(df, length, prefix, mark_bits=16, hot=hot).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, length)


def test_text_back_and_edges(spark):
    rows = [(None, "a" * 300), (1, "b" * 150), (1, "b" * 150), (2, None)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True, mark_bits=16).collect()
    assert sorted((r.doc_id or 0, len(r.kept), r.n_removed) for r in got) == [(0, 300, 0), (1, 1, 149), (1, 1, 149), (2, 0, 0)]
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), mark_bits=16).collect() == []


def test_samples_follow_content():
    draw = random.Random(0)
    common = "".join(draw.choices("abcdef", k=120))
    found = []
    for pad in (0, 7, 300):
        data, offsets = text_bytes(pa.array(["".join(draw.choices("abcdef", k=pad)) + common]))
        s = suffix_dedup.Samples(data, offsets, 100, 32)
        found.append({int(k) for k, last in zip(s.key, s.last, strict=True) if last >= pad})
    assert found[0] <= found[1] and found[0] <= found[2]


def test_levels_merge_geometrically():
    draw = random.Random(3)
    length, prefix, texts = 20, 6, []
    common = ["".join(draw.choices("ab", k=30)) for _ in range(4)]
    index = suffix_dedup.Family()
    for i in range(40):
        text = "".join(draw.choice(common)[: draw.randint(5, 30)] for _ in range(12))
        texts.append((99 - i, text))
        data, offsets = text_bytes(pa.array([text]))
        s = suffix_dedup.Samples(data, offsets, length, prefix)
        head = np.empty(len(s.key), dtype=suffix_dedup.HEAD)
        head["doc"], head["start"], head["size"], head["at"] = 99 - i, s.first, s.last - s.first + length, s.at - s.first
        raw = np.concatenate([data[a : a + n] for a, n in zip(head["start"], head["size"], strict=True)])
        index.add(suffix_dedup.SuffixArray.of(head, raw, length, prefix))
    assert len(index.levels) <= 7
    for level in index.levels:
        assert sorted(level.behind.tolist()) == level.behind[level.by_behind].tolist()
    gone = {d: np.zeros(len(t), dtype=bool) for d, t in texts}
    for d, a, b in index.close().tolist():
        gone[d][a:b] = True
    assert sorted((d, int(gone[d].sum())) for d, _ in texts) == sorted((d, n) for d, _, n, _, _ in brute(texts, length))


def test_driver_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = suffix_dedup.remove_repeats(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), hot=20).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 100)
