"""The manifest against a plain version of its contract, and every edge case."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from inkscan.llm import merkle
from inkscan.llm.queries import ORACLES, QUERIES
from tests.llm.oracles import same

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, text):
    return h(*map(framed, row[:4]), framed(text))


def tree(hashes, fanout):
    """The root, and for each leaf its siblings as (before, after), run by run."""
    paths, level, members = [[] for _ in hashes], list(hashes), [[i] for i in range(len(hashes))]
    while len(level) > 1:
        runs = [range(i, min(i + fanout, len(level))) for i in range(0, len(level), fanout)]
        for run in runs:
            for i in run:
                for leaf_at in members[i]:
                    paths[leaf_at].append(("".join(level[j] for j in run if j < i), "".join(level[j] for j in run if j > i)))
        members = [[m for i in run for m in members[i]] for run in runs]
        level = [h(*(level[i] for i in run)) for run in runs]
    return level[0], paths


def brute(rows, fanout=3):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    grown = {}
    for s in sources:
        own = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        grown[s] = own, *tree([leaf(r, r[4]) for r in own], fanout)
    root, above = tree([grown[s][1] for s in sources], fanout) if sources else (None, [])
    out = []
    for s, up in zip(sources, above, strict=True):
        own, subroot, paths = grown[s]
        for r, path in zip(own, paths, strict=True):
            path = path + up
            touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            folded = leaf(r, r[4].replace("\n", "") if touched else r[4])
            for before, after in path:
                folded = h(before, folded, after)
            out.append((r[0], leaf(r, r[4]), subroot, root, h(*(x for p in path for x in p)), folded, folded == root))
    return sorted(out, key=repr)


def found(df, fanout=3):
    return sorted(map(tuple, merkle.manifest(df, fanout).collect()), key=repr)


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_against_brute_force(spark, fanout):
    draw = random.Random(fanout)
    rows = [(i, "big", "en", i, f"a{i}\nb") for i in range(40)]
    rows += [(100 + i, draw.choice(["", "é", "z", None, "-", "="]), draw.choice([None, "de"]), None, draw.choice([None, "", "\n", "x\n\ny", "ü\n"])) for i in range(25)]
    rows += [(500, "one", "en", 3, "abc"), (-7, "two", "en", 1, "\n")]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("hash", F.lit("x")).withColumn("key", F.lit(1)).withColumn("n", F.lit(1)).repartition(3)
    assert found(df, fanout) == brute(rows, fanout)


def test_repeated_rows_and_ids(spark):
    rows = [(1, "a", "en", 1, "x\n")] * 5 + [(1, "a", "en", 2, "y\n"), (None, "a", None, None, None), (None, "a", None, None, "q\n")] + [(2, None, None, None, None)] * 2
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_one_row_one_source_none(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    one = [(4, None, None, None, "a\nb")]
    assert found(spark.createDataFrame(one, SCHEMA)) == brute(one)
    ten = [(i, "s", None, None, "a\nb") for i in range(10)]
    assert found(spark.createDataFrame(ten, SCHEMA)) == brute(ten)


def test_many_ranges_of_one_source(spark):
    """Row numbers go on from range to range, and sizes of groups are those of all ranges."""
    df = spark.range(2000).select(F.lit("s").alias("key"), (F.col("id") * 7919 % 2003).alias("doc_id"))
    from inkscan.llm.shared import cut

    rows = merkle.numbered(cut(df), "key", ["doc_id"]).select("doc_id", "idx", "n").collect()
    assert [r.idx for r in sorted(rows)] == list(range(2000)) and {r.n for r in rows} == {2000}


def test_query(spark):
    rows = same(spark, QUERIES["op12_merkle"], ORACLES["op12_merkle"])
    assert len(rows) == 1000
