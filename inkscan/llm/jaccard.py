"""N-gram Jaccard self-join with set-relation skipping.

Every text is a set of five-word shingles.  Two sets link when their Jaccard similarity is at
least 75 %.  The plan, over tables that stay partitioned:

1. Equal sets are one set (a 64-bit fingerprint), so exact copies cost one row each.
2. A total order of shingles puts frequent ones last.  Frequencies come from a counting sketch of
   a fixed number of counters over all texts, so what is sent to the tasks has a fixed size; a
   collision changes the order, never the result.
3. Only the prefix of each ordered set is indexed: two linked sets share a shingle in their
   prefixes.  A list is sorted by size and cut into blocks that know their sizes and positions; a
   pair of blocks whose sizes or positions rule out enough overlap is skipped before any of its
   pairs is made.  The entries that a pair shares are counted, and the count bounds the overlap;
   pairs under the bound are skipped too.
4. A list too long to be paired off gives a star instead, and a shingle in very many sets joins
   each of them to a node of its own without a list.  Stars and pairs make candidate clusters; a
   link never crosses two clusters.
5. Clusters are verified exactly.  There a set's overlaps with all others are derived from those of
   the set before it, by the lists of the few shingles in which the two differ, where that is
   shorter than starting anew.  A large cluster is cut into chunks; each is compared in itself and
   with a few sets of the whole cluster.  Only sets that this leaves apart from the cluster's
   largest component are then compared with the other chunks.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkscan.llm.bytesops import LOWER, give_back, in_slices, minimum_labels, mix, pieces, shingles, text_bytes, word_places
from inkscan.llm.shared import components, cut, new_path, partitions, small_batches

U64 = np.uint64
WORDS = 5
PERCENT = 75
SKETCH_BITS = 23
SKETCH_CHUNK_BITS = 18
BLOOM_BITS = 26
BLOOM_CHUNK_BITS = 21
#: A list of more entries gives a star instead of all its pairs; lists are cut into blocks of so many.
LONG_LIST, BLOCK = 64, 8
#: A shingle of about so many sets has no list.
HOT = 50_000
#: Pairs of entries that a task holds before it counts them and hands them on.
PAIRS = 1 << 18
#: Sets of a cluster that are compared in one go.
CHUNK = 1024
#: A text is hashed in blocks of so many bytes, which end at white space.
TEXT_BLOCK = 1 << 19


def shingle_sets(column: pa.Array, block: int = TEXT_BLOCK) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ascending distinct shingle hashes) of every text with a word."""
    data, offsets = text_bytes(column)
    for a, b in pieces(offsets):
        _, _, hashes, words = word_places(LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a], block)
        found, first = shingles(hashes, words, WORDS)
        for i in np.flatnonzero(np.diff(first)):
            yield a + int(i), np.unique(found[first[i] : first[i + 1]])


def fingerprint(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        total = mix(s ^ U64(0xA5A5A5A5DEADBEEF)).sum(dtype=U64) + U64(len(s)) * U64(0x9E3779B97F4A7C15)
    return int(mix(np.array([total], dtype=U64)).view(np.int64)[0])


def required(n: int) -> int:
    """The least size of a set that can link with one of n shingles, and the least overlap of the two."""
    return -(-n * PERCENT // 100)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list, np.ndarray, list[tuple[int, np.ndarray]]]]:
    """Slices of a task's rows: fingerprint (None for an empty set) and size of each row's set, and the sets that the task meets for the first time."""
    seen: set[int] = set()
    for batch in in_slices(batches):
        fp, n, new = [None] * len(batch), np.zeros(len(batch), dtype=np.int64), []
        for i, s in shingle_sets(batch.column("text")):
            fp[i], n[i] = fingerprint(s), len(s)
            if fp[i] not in seen:
                seen.add(fp[i])
                new.append((fp[i], s))
        yield batch, fp, n, new


def _prints(documents: DataFrame, bits: int) -> DataFrame:
    """(doc_id, fp, n) per row, written once, and rows of (k, counts) with each task's part of the sketch.

    The sets themselves are made again from the texts where they are needed: hashing costs less than disk of the texts' size.
    """
    chunk = min(SKETCH_CHUNK_BITS, bits)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, names, any_rows = np.zeros(1 << bits, dtype=np.uint32), ["doc_id", "fp", "n", "k", "counts"], False
        for batch, fp, n, new in _hashed(batches):
            if new:
                slots, times = np.unique(np.concatenate([s >> U64(64 - bits) for _, s in new]), return_counts=True)
                counts[slots] += times.astype(np.uint32)
                any_rows = True
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp, pa.int64()), pa.array(n), pa.nulls(len(batch), pa.int32()), pa.nulls(len(batch), pa.binary())], names=names)
        if any_rows:
            none = pa.nulls(1, pa.int64())
            for k, part in enumerate(counts.reshape(-1, 1 << chunk)):
                yield pa.RecordBatch.from_arrays([none, none, none, pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=names)
        del counts
        give_back()

    path = new_path(documents.sparkSession, "prints")
    documents.mapInArrow(compute, "doc_id long, fp long, n long, k int, counts binary").write.parquet(path)
    return documents.sparkSession.read.parquet(path)


def _sketch(parts: DataFrame, bits: int) -> np.ndarray:
    """A frequency class per counter: eight steps for every doubling of the count."""
    chunk = min(SKETCH_CHUNK_BITS, bits)

    def total(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << chunk, dtype=np.uint64)
        for batch in batches:
            for blob in batch.column("counts"):
                counts += np.frombuffer(zlib.decompress(blob.as_py()), dtype=np.uint32)
        classes = np.ceil(8 * np.log2(counts + 1.0)).astype(np.uint8)  # 2**31 is in class 248
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(classes.tobytes(), 1)], pa.binary())], names=["k", "classes"])

    out = np.zeros(1 << bits, dtype=np.uint8)  # of a fixed size, whatever the input
    for row in parts.groupBy("k").applyInArrow(total, "k int, classes binary").collect():
        out[row["k"] << chunk : (row["k"] + 1) << chunk] = np.frombuffer(zlib.decompress(bytes(row["classes"])), dtype=np.uint8)
    return out


ENTRY = np.dtype([("token", "<u4"), ("fp", "<i8"), ("size", "<u4"), ("at", "<u4")])


def _index(documents: DataFrame, sketch: np.ndarray, buckets: int, hot: int) -> DataFrame:
    """(bucket, entries, edges): packed prefix entries of all distinct sets, dealt by shingle; of hot shingles packed edges instead."""
    bits, class_of_hot = int(np.log2(len(sketch))), np.ceil(8 * np.log2(hot + 1.0))
    sent = documents.sparkSession.sparkContext.broadcast(sketch)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, new in _hashed(batches):
            tokens, rows = [], []
            for fp, s in new:
                key = (sent.value[s >> U64(64 - bits)].astype(U64) << U64(56)) | (s >> U64(8))
                prefix = s[np.argsort(key, kind="stable")[: len(s) - required(len(s)) + 1]]
                tokens.append(prefix)
                rows.append((fp, len(s), len(prefix)))
            if not tokens:
                continue
            raw, (fps, sizes, lengths) = np.concatenate(tokens), np.array(rows, dtype=np.int64).T
            busy = sent.value[raw >> U64(64 - bits)] >= class_of_hot
            token = mix(raw)
            out = np.empty(len(token), dtype=ENTRY)
            out["token"] = token & U64(0xFFFFFFFF)  # with the bucket, enough to group by; what it mixes up is verified
            out["fp"], out["size"] = np.repeat(fps, lengths), np.repeat(sizes, lengths)
            out["at"] = np.arange(len(token)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            edges = np.stack([out["fp"][busy], token[busy].view(np.int64)], axis=1)
            bucket = ((token[~busy] >> U64(32)) % U64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            out, bucket = out[~busy][order], bucket[order]
            at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else bucket
            blobs: list = [p.tobytes() for p in np.split(out, at[1:])] if len(bucket) else []
            dealt, links = bucket[at].tolist(), [None] * len(blobs)
            if len(edges):
                dealt, blobs, links = [*dealt, int(fps[0] % buckets)], [*blobs, None], [*links, edges.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(dealt, pa.int32()), pa.array(blobs, pa.binary()), pa.array(links, pa.binary())], names=["bucket", "entries", "edges"])
        give_back()

    return documents.select("text").mapInArrow(entries, "bucket int, entries binary, edges binary")


def _counted(e: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs of entries as pairs of sets, each with how many of these entries it shares."""
    a, b = np.minimum(e["fp"][x], e["fp"][y]), np.maximum(e["fp"][x], e["fp"][y])
    order = np.lexsort((b, a))
    a, b, x, y = a[order], b[order], x[order], y[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    shared = np.diff(np.append(first, len(a)))
    a, b, x, y = a[first], b[first], x[first], y[first]
    flip = e["fp"][x] != a
    x, y = np.where(flip, y, x), np.where(flip, x, y)
    columns = [a, b, e["size"][x].astype(np.int64), e["size"][y].astype(np.int64), shared]
    for k in range(0, len(a), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(c[k : k + (1 << 16)]) for c in columns], names=["a", "b", "n_a", "n_b", "shared"])


def _star(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none, none, none], names=["a", "b", "n_a", "n_b", "shared"])


def _block_pairs(e: np.ndarray, begin: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of entries that may link, list by list; each list ascends by size."""
    count = -(-length // BLOCK)
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    first = np.repeat(begin, count) + inner * BLOCK
    last = np.minimum(first + BLOCK, np.repeat(begin + length, count))
    size, at = e["size"].astype(np.int64), e["at"].astype(np.int64)
    least, most = size[first], size[last - 1]
    # blocks may stand apart: each is reduced up to its own end
    edges = np.stack([first, last], axis=1).ravel()
    pad = lambda x: np.append(x, 0)
    furthest, rest = (np.maximum.reduceat(pad(x), edges)[::2] if len(first) else first for x in (at, size - at - 1))
    start = np.cumsum(count) - count
    for n in np.unique(count):
        lists, (i, j) = start[count == n], np.triu_indices(n)
        for part in np.array_split(lists, max(1, len(lists) * len(i) * BLOCK * BLOCK // PAIRS)):
            x, y = (part[:, None] + i).ravel(), (part[:, None] + j).ravel()
            overlap = np.minimum(furthest[x], furthest[y]) + 1 + np.minimum(rest[x], rest[y])
            ok = (most[x] * 100 >= least[y] * PERCENT) & (overlap >= -(-(least[x] + least[y]) * PERCENT // (100 + PERCENT)))
            x, y = x[ok], y[ok]
            step = np.arange(BLOCK)
            p = np.broadcast_to((first[x][:, None] + step)[:, :, None], (len(x), BLOCK, BLOCK))
            q = np.broadcast_to((first[y][:, None] + step)[:, None, :], (len(x), BLOCK, BLOCK))
            inside = (p < last[x][:, None, None]) & (q < last[y][:, None, None]) & (p < q)
            p, q = p[inside], q[inside]
            need = -(-(size[p] + size[q]) * PERCENT // (100 + PERCENT))
            reach = np.minimum(at[p], at[q]) + 1 + np.minimum(size[p] - at[p] - 1, size[q] - at[q] - 1)  # before, here and behind
            yield p[reach >= need], q[reach >= need]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n_a, n_b, shared) per pair of sets that share entries of this partition; shared is null for a star's edge."""
    blobs = []
    for batch in batches:
        blobs += [np.frombuffer(x.as_py(), dtype=ENTRY) for x in batch.column("entries") if x.is_valid]
        for x in batch.column("edges"):
            if x.is_valid:
                pair = np.frombuffer(x.as_py(), dtype=np.int64).reshape(-1, 2)
                yield _star(np.ascontiguousarray(pair[:, 0]), np.ascontiguousarray(pair[:, 1]))
    if not blobs:
        return
    e = np.concatenate(blobs)
    del blobs
    e = e[np.lexsort((e["at"], e["fp"], e["size"], e["token"]))]
    # The same set may come from two tasks.  Two shingles of a set under one token both stay: counts may only be too high.
    fresh = (e["token"][1:] != e["token"][:-1]) | (e["fp"][1:] != e["fp"][:-1]) | (e["at"][1:] != e["at"][:-1])
    e = e[np.concatenate([[True], fresh])]
    begin = np.flatnonzero(np.concatenate([[True], e["token"][1:] != e["token"][:-1]]))
    length = np.diff(np.append(begin, len(e)))
    left, right, waiting = [], [], 0
    short = (length > 1) & (length <= LONG_LIST)
    for x, y in _block_pairs(e, begin[short], length[short]):
        left.append(x.astype(np.int32))
        right.append(y.astype(np.int32))
        waiting += len(x)
        if waiting >= PAIRS:
            yield from _counted(e, np.concatenate(left), np.concatenate(right))
            left, right, waiting = [], [], 0
    if waiting:
        yield from _counted(e, np.concatenate(left), np.concatenate(right))
    for i in np.flatnonzero(length > LONG_LIST):
        fps = e["fp"][begin[i] : begin[i] + length[i]]
        size = e["size"][begin[i] : begin[i] + length[i]].astype(np.int64)
        # within a list, sizes ascend: a gap over which no link reaches splits the star
        cluster = np.concatenate([[0], np.cumsum(size[1:] * PERCENT > size[:-1] * 100)])
        yield _star(fps, fps[np.searchsorted(cluster, cluster)])
    del e, begin, length, left, right
    give_back()


def _bloom(fps: DataFrame, column: str, bits: int = BLOOM_BITS) -> np.ndarray:
    """A bit per hash of ``column``; of a fixed size, so a filter that may pass too much, never too little."""
    chunk = min(BLOOM_CHUNK_BITS, bits)

    def fill(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << chunk, dtype=bool)
        for batch in batches:
            flags[np.asarray(batch.column("slot"))] = True
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(flags).tobytes()], pa.binary())], names=["k", "bits"])

    slot = F.shiftrightunsigned(F.col(column), 64 - bits)
    slots = fps.select(F.shiftright(slot, chunk).cast("int").alias("k"), (slot % (1 << chunk)).cast("int").alias("slot")).distinct()
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for row in slots.groupBy("k").applyInArrow(fill, "k int, bits binary").collect():
        size = 1 << (chunk - 3)
        out[row["k"] * size : (row["k"] + 1) * size] = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
    return out


def _passing(documents: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(fp, tokens): the sets that pass the filter, each once."""
    bits = int(np.log2(len(wanted))) + 3
    sent = documents.sparkSession.sparkContext.broadcast(wanted)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, new in _hashed(batches):
            fp = np.array([f for f, _ in new], dtype=np.int64)
            slot = fp.view(U64) >> U64(64 - bits)
            some = np.flatnonzero(sent.value[slot >> U64(3)] >> (U64(7) - (slot & U64(7))).astype(np.uint8) & 1 == 1)
            yield pa.RecordBatch.from_arrays([pa.array(fp[some]), pa.array([new[i][1].tobytes() for i in some], pa.binary())], names=["fp", "tokens"])
        give_back()

    return documents.select("text").mapInArrow(select, "fp long, tokens binary").groupBy("fp").agg(F.first("tokens").alias("tokens"))


def links(sets: list[np.ndarray], split: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j), i < j, of the sets that link; with ``split``, only those with i < split <= j.

    Sets must be in an order that puts similar ones together for the derivation to save work.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    tokens, ids = np.unique(np.concatenate(sets), return_inverse=True)
    members = np.argsort(ids, kind="stable")
    members, first = np.repeat(np.arange(n), size)[members], np.searchsorted(np.sort(ids), np.arange(len(tokens) + 1))
    own = np.split(ids, np.cumsum(size)[:-1])

    def holders(tokens: np.ndarray) -> np.ndarray:
        """How many of ``tokens`` each set has."""
        count = first[tokens + 1] - first[tokens]
        at = np.arange(count.sum()) + np.repeat(first[tokens] - (np.cumsum(count) - count), count)
        return np.bincount(members[at], minlength=n)

    left, right, overlap = [], [], None
    cost = first[1:] - first[:-1]
    for i in range(n if split is None else split):
        gone = came = None
        if overlap is not None:
            gone, came = np.setdiff1d(own[i - 1], own[i], assume_unique=True), np.setdiff1d(own[i], own[i - 1], assume_unique=True)
        if gone is not None and cost[gone].sum() + cost[came].sum() < cost[own[i]].sum():
            overlap = overlap - holders(gone) + holders(came)
        else:
            overlap = holders(own[i])
        j = np.flatnonzero(100 * overlap >= PERCENT * (size + size[i] - overlap))
        j = j[j > i] if split is None else j[j >= split]
        left.append(np.full(len(j), i))
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def _verify(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning edges (a, b) of the links among the sets of each cluster, or between those of its two sides."""
    table = pa.Table.from_batches(list(batches))
    fp, cluster, side = (table.column(c).to_numpy() for c in ("fp", "cluster", "side"))
    tokens = table.column("tokens").to_pylist()
    order = np.lexsort((side, cluster))
    out_a, out_b = [], []
    for rows in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1):
        if len(rows) < 2:
            continue
        sets = {r: np.frombuffer(tokens[r], dtype=U64) for r in rows}
        rows = np.array(sorted(rows, key=lambda r: (side[r], len(sets[r]), tokens[r])))  # noqa: B023
        split = int((side[rows] == side[rows[0]]).sum())
        a, b = links([sets[r] for r in rows], split if split < len(rows) else None)
        label = minimum_labels(len(rows), a, b)
        child = np.flatnonzero(label != np.arange(len(rows)))
        out_a.append(fp[rows[child]])
        out_b.append(fp[rows[label[child]]])
    a, b = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (out_a, out_b))
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _clusters(documents: DataFrame, sketch: np.ndarray, buckets: int, hot: int) -> DataFrame:
    """(fp, cluster): sets that a chain of candidates connects."""
    index = _index(documents, sketch, buckets, hot).repartition(buckets, "bucket")
    found = index.mapInArrow(_candidates, "a long, b long, n_a long, n_b long, shared long")
    pairs = found.groupBy("a", "b").agg(F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"), F.sum("shared").alias("shared"), F.max(F.col("shared").isNull()).alias("star"))
    # what neither prefix shows is at most the rest of one of the sets
    behind = F.greatest(F.expr(f"(n_a * {PERCENT} + 99) div 100 - 1"), F.expr(f"(n_b * {PERCENT} + 99) div 100 - 1"))
    need = F.expr(f"((n_a + n_b) * {PERCENT} + {99 + PERCENT}) div {100 + PERCENT}")
    edges = pairs.where(F.col("star") | (F.col("shared") + behind >= need)).select("a", "b").where("a <> b")
    return cut(components(edges).select(F.col("id").alias("fp"), F.col("label").alias("cluster")))


def _linked(documents: DataFrame, sketch: np.ndarray, buckets: int, hot: int) -> DataFrame:
    """(id, label) of the fingerprints that link with another."""
    clusters = _clusters(documents, sketch, buckets, hot)
    bins = max(1, clusters.count() // CHUNK)
    sizes = clusters.groupBy("cluster").agg(
        F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"), F.array(F.min("fp"), F.max("fp"), F.min_by("fp", F.xxhash64("fp"))).alias("some")
    )
    dealt = clusters.join(sizes, "cluster").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    member = dealt.select("fp", "cluster", "chunks", "part", F.array_contains("some", F.col("fp")).alias("everywhere"))
    wanted = _passing(documents, _bloom(clusters, "fp"))
    whole = F.when(F.col("everywhere"), F.expr("sequence(0, chunks - 1)")).otherwise(F.array("part"))
    # small clusters share a group; a chunk of a large one is a group with a few sets of its whole cluster
    first = wanted.join(member, "fp").select(
        "fp", "cluster", "tokens", F.lit(0).alias("side"), F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(bins))).otherwise(F.col("cluster")).alias("bin"),
        F.explode(F.when(F.col("chunks") == 1, F.array(F.lit(-1))).otherwise(whole)).alias("chunk"),
    )
    edges = cut(first.groupBy("bin", "chunk").applyInArrow(_verify, "a long, b long"))
    label = cut(components(edges))
    large = cut(member.where("chunks > 1"))
    if large.isEmpty():
        return label
    placed = large.join(label, F.col("fp") == F.col("id"), "left").select("fp", "cluster", "chunks", "part", F.coalesce("label", "fp").alias("label"))
    main = placed.groupBy("cluster", "label").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    placed = cut(placed.join(main, "cluster").withColumn("apart", F.col("label") != F.col("main")))
    apart = placed.where("apart").groupBy("cluster").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"))
    if apart.isEmpty():
        return label
    # every set of such a cluster against those that are apart
    open_ = wanted.join(placed.join(apart, "cluster"), "fp")
    ours = open_.select("fp", "cluster", "tokens", F.lit(0).alias("side"), F.col("part").alias("low"), F.explode(F.expr("sequence(0, parts - 1)")).alias("high"))
    theirs = open_.where("apart").select(
        "fp", "cluster", "tokens", F.lit(1).alias("side"), F.explode(F.expr("sequence(0, chunks - 1)")).alias("low"), F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("high")
    )
    more = ours.unionByName(theirs).groupBy("cluster", "low", "high").applyInArrow(_verify, "a long, b long")
    return cut(components(edges.unionByName(more)))


def near_copies(documents: DataFrame, buckets: int | None = None, sketch_bits: int = SKETCH_BITS, hot: int = HOT) -> DataFrame:
    """Per document: doc_id, n_shingles (size of its set), component_id, set_id.

    component_id is the smallest doc_id that links reach, its own included; set_id is equal for
    documents of equal sets.  A null text counts as empty: no shingles, linked with nothing, its
    own component.  Every input row gives a row, repeated ones too; other columns are ignored.
    ``documents`` is read three times (sketch, index, verification), so it should be a table.
    """
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = documents.sparkSession
    small_batches(spark)
    written = _prints(documents, sketch_bits)
    prints = written.where("k is null").select("doc_id", "fp", "n")
    sketch = _sketch(written.where("k is not null").select("k", "counts"), sketch_bits)
    total = prints.agg(F.sum("n")).first()[0] or 0
    # about a quarter of the shingles are indexed; a partition sorts about a million entries
    buckets = buckets or max(partitions(spark), total // 4_000_000 + 1)
    sets = prints.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("least"))
    label = _linked(documents, sketch, buckets, hot)
    joined = sets.join(label, sets["fp"] == label["id"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    group = joined.groupBy("label").agg(F.min("least").alias("component_id"))
    by_set = joined.join(group, "label").select("fp", "component_id")
    return prints.join(by_set, "fp", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.col("fp").alias("set_id")
    )
