import random
import re

import numpy as np
import pyarrow as pa
import pytest

from inkscan.llm import quality
from inkscan.llm.bytesops import text_bytes


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)]


def texts():
    draw = random.Random(5)
    parts = ["a", "b", "c ", " ", "\n", "é", "# ", "|", "x y z w v ", " ", "\t", "🚀", "A.", "1"]
    return [None, "", " \n\n ", "a", "\n", "a\na\na", "w " * 30, *("".join(draw.choices(parts, k=draw.randint(1, 80))) for _ in range(200))]


def test_statistics():
    data, offsets = text_bytes(pa.array(texts(), pa.string()))
    got = quality.statistics(data, offsets)
    for i, t in enumerate(texts()):
        assert [int(got[c][i]) for c in quality.COUNTS] == brute(t), repr(t)


def test_long_lines_of_two_letters():
    """Lines that a polynomial modulo a power of two can't tell apart, and a very long text."""
    s, lines = "ab", []
    while len(s) < 1 << 13:
        lines += [s, s.translate(str.maketrans("ab", "ba"))]
        s += lines[-1]
    texts = ["\n".join(lines), "\n".join(lines * 2), ("word and more of it, line " * 20 + "\n") * 3000 + "é🚀 # end"]
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    got = quality.statistics(data, offsets)
    assert got["n_dup_lines"].tolist() == [0, len(lines), 2999]
    assert got["n_words"].tolist() == [len(t.split()) for t in texts]


def test_flat_trees_as_a_walk():
    """The arrays of nodes against a walk from node to node."""
    rng = np.random.default_rng(2)
    x = rng.random((400, 3))
    trees = quality.fit(x, (x[:, 0] + x[:, 2] > 1).astype(float), [1, -1, 0], rounds=7)

    def walk(row, node):
        while trees.left[node] != node:
            node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
        return trees.value[node]

    want = [1 / (1 + np.exp(-(trees.base + sum(walk(r, root) for root in trees.roots)))) for r in x]
    assert np.allclose(trees.score(x), want)


def test_trees_are_monotone_and_learn():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = ((x[:, 0] < 0.6) & (rng.random(3000) < 0.95)).astype(float)
    trees = quality.fit(x, y, [-1, 0, 1])
    assert ((trees.score(x) > 0.5) == y).mean() > 0.93
    line = np.tile([0.5, 0.5, 0.5], (200, 1))
    for j, sign in ((0, -1), (2, 1)):
        sweep = line.copy()
        sweep[:, j] = np.linspace(0, 1, 200)
        assert (np.diff(trees.score(sweep)) * sign >= -1e-12).all()


def test_judge(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(3, "a", "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    labels = spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, quality int")
    got = quality.judge(df, quality.train(df, labels), ["doc_id"]).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, t, _ in rows[:-1]:
        n, *_, repeats = brute(t)
        assert by_id[i].base_failed == (n < 10 or 100 * repeats > 20 * n) and by_id[i].kept == (not by_id[i].base_failed)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert quality.judge(none, quality.train(none, labels), ["doc_id"]).collect() == []


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.1"])
def test_accuracy_on_labels(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    from pyspark.sql import functions as F

    trees = quality.train(docs, labels.where("doc_id % 2 = 0"))
    judged = quality.judge(docs, trees, ["doc_id"]).join(labels.where("doc_id % 2 = 1"), "doc_id")
    r = judged.groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept"), F.avg((F.col("quality_score") >= 0.5).cast("double")).alias("by_trees")).collect()
    kept = {x.quality: x for x in r}
    print(kept)
    assert kept[1].kept > 0.97 and kept[0].by_trees < 0.4
