"""Merkle manifest of a dataset: a tree per source, a tree over the sources, and a proof per document.

Leaves get their row numbers within their source; the number divided by the fanout names the parent.
A level is one aggregate: nodes are grouped by source and parent number, and the sorted children are
hashed into the parent.  Levels are written tables, each about a third of the one below.

Proofs take one join per level, from the root down: a run of children meets the siblings that lie
above its parent, and every child appends those to its own siblings.  So a node's siblings move once
per node of its level, and not once per document and level; a document meets its whole proof once, where
it is hashed and folded on the row.

A source may hold most of the rows: row numbers come from ranges of (source, order), each numbered
apart, and the sizes of the ranges before; runs have at most ``fanout`` rows whatever the source.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkscan.llm.shared import cut, partitions

FANOUT = 3
#: Rows in a range that is numbered by one task, at most on average.
RANGE_ROWS = 500_000
#: Levels that one plan joins, counted from the leaves.
WRITTEN = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NO_SIBLINGS = "cast(array() as array<struct<before:string,after:string>>)"


def framed(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(text: Column) -> Column:
    return F.sha2(F.concat(*(framed(F.col(c)) for c in FIELDS[:-1]), framed(text)), 256)


def source_key(source: Column) -> Column:
    """A key that is never null and sorts as sources do: null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def leaves(documents: DataFrame) -> DataFrame:
    """(key, doc_id, leaf, altered, tie) per document; altered is null where tampering doesn't touch the document.

    Where 2 divides the checksum of the id, tampering deletes the text's line feeds.
    """
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False)) & F.coalesce(F.col("text").contains("\n"), F.lit(False))
    altered = F.when(touched, leaf_hash(F.translate("text", "\n", "")))
    df = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")), F.col("n_chars").cast("long").alias("n_chars"))
    return df.select(source_key(F.col("source")).alias("key"), "doc_id", leaf_hash(F.col("text")).alias("leaf"), altered.alias("altered"), F.monotonically_increasing_id().alias("tie"))


def numbered(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``df``, a written table, with ``idx``, the place from 0 in its group by ``order``, and ``n``, the group's size.

    Rows are dealt to ranges of (group, order); each range's share of a group is numbered by itself,
    after the rows of the ranges before.  Nothing orders a whole group.
    """
    ranges = max(partitions(df.sparkSession), df.count() // RANGE_ROWS + 1)
    dealt = cut(df.repartitionByRange(ranges, group, *order).withColumn("part", F.spark_partition_id()))
    own = dealt.withColumn("idx", F.row_number().over(Window.partitionBy("part", group).orderBy(*order)).cast("long") - 1)
    # a row per range and group, of which a group has as many as ranges
    sizes = dealt.groupBy("part", group).agg(F.count("*").alias("size"))
    of_group = Window.partitionBy(group)
    before = F.coalesce(F.sum("size").over(of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("part", group, before.alias("before"), F.sum("size").over(of_group).alias("n"))
    return own.join(sizes, ["part", group]).withColumn("idx", F.col("idx") + F.col("before")).drop("part", "before")


@dataclass(frozen=True)
class Forest:
    """The levels of one tree per key: ``runs[k]`` holds (key, idx, n, hash, children) of parents of level k's nodes; ``tops[k]`` (key, hash) of those that are roots on level k."""

    runs: list[DataFrame]
    tops: list[DataFrame]


def grow(nodes: DataFrame, more: list[str], fanout: int = FANOUT) -> Forest:
    """Trees over ``nodes`` (key, idx, n, hash and, of the lowest level, ``more``), until each key has one node."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    runs, tops = [], []
    while True:
        tops.append(nodes.where("n = 1").select("key", "hash"))
        if most <= 1:
            break
        child = F.struct("idx", "hash", *more)
        run = nodes.where("n > 1").groupBy("key", F.expr(f"idx div {fanout}").alias("parent")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(child)).alias("children"))
        joined = F.sha2(F.array_join(F.transform("children", lambda c: c["hash"]), ""), 256)
        run = cut(run.select("key", F.col("parent").alias("idx"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), joined.alias("hash"), "children"))
        runs.append(run)
        nodes, more, most = run, [], -(-most // fanout)
    return Forest(runs, tops)


def descend(forest: Forest, nodes: DataFrame, above: DataFrame, more: list[str]) -> DataFrame:
    """(key, hash, ``more``, path) of ``nodes``, the lowest level: the siblings of every node, run by run up to its top, then those above.

    ``above`` has a row per key: path, the siblings above the top, and whatever else each node of the
    key is to carry.
    """
    carried = [c for c in above.columns if c not in ("key", "path")]
    paths = None
    for level in range(len(forest.runs) - 1, -1, -1):
        up = forest.tops[level + 1].join(above, "key").select("key", F.lit(0).cast("long").alias("idx"), "path", *carried)
        up = up if paths is None else paths.select(*up.columns).unionByName(up)
        run = forest.runs[level].select("key", "idx", "children").join(up, ["key", "idx"])
        hashes = F.transform("children", lambda c: c["hash"])
        each = run.select("key", F.posexplode("children").alias("at", "c"), hashes.alias("hashes"), F.col("path").alias("rest"), *carried)
        own = F.struct(
            F.array_join(F.slice("hashes", F.lit(1), F.col("at")), "").alias("before"),
            F.array_join(F.slice("hashes", F.col("at") + 2, F.size("hashes")), "").alias("after"),
        )
        lowest = [F.col("c.hash").alias("hash"), *(F.col(f"c.{m}").alias(m) for m in more)] if level == 0 else []
        paths = each.select("key", F.col("c.idx").alias("idx"), *lowest, F.concat(F.array(own), "rest").alias("path"), *carried)
        if level and level % WRITTEN == 0:
            paths = cut(paths)  # one plan holds a few levels, however high the tree
    alone = nodes.where("n = 1").join(above, "key").select("key", "hash", *more, "path", *carried)
    return alone if paths is None else paths.select(*alone.columns).unionByName(alone)


def manifest(documents: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the hash of doc_id, source, lang, n_chars and text, each with its length.  Leaves of a
    source ascend by doc_id (null first); rows that repeat an id follow each other by their hashes,
    and equal rows in any order, each a leaf with a proof of its own.  A null source is a source of
    its own, the first.  The proof is the hash of the siblings from the leaf's run up to the root; the
    folded root is computed from the tampered document, where it is touched, and the original siblings.
    A null text stays null when tampered with; a null id is never tampered with.  An empty table gives
    no rows; other columns are ignored.
    """
    written = cut(leaves(documents))
    # the lowest level is needed by its runs and by sources of one leaf
    nodes = numbered(written, "key", ["doc_id", "leaf", "tie"]).select("key", "idx", "n", F.col("leaf").alias("hash"), "doc_id", "altered")
    nodes = cut(nodes)
    more = ["doc_id", "altered"]
    trees = grow(nodes, more, fanout)
    subroots = cut(reduce(DataFrame.unionByName, trees.tops).select(F.col("key").alias("source_key"), F.col("hash").alias("subroot")))
    upper = numbered(subroots.withColumn("key", F.lit("")), "key", ["source_key"])
    upper = cut(upper.select("key", "idx", "n", F.col("subroot").alias("hash"), "source_key"))
    top = grow(upper, ["source_key"], fanout)
    root = reduce(DataFrame.unionByName, top.tops).select("key", F.expr(NO_SIBLINGS).alias("path"), F.col("hash").alias("root"))
    # siblings of every subroot; with one source it is the root
    above = cut(descend(top, upper, root, ["source_key"]).select(F.col("source_key").alias("key"), "path", F.col("hash").alias("subroot"), "root"))
    proven = descend(trees, nodes, above, more)
    siblings = F.array_join(F.flatten(F.transform("path", lambda s: F.array(s["before"], s["after"]))), "")
    folded = F.aggregate("path", F.coalesce("altered", "hash"), lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))
    out = proven.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))

