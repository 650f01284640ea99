"""Embedding near-duplicates by int8 tile products with rigorous bounds.

Rows of equal vectors (up to powers of two) are one vector with a count, so copies cost nothing.  Unit vectors are quantised to int8 with a scale each.  For x = a*q + r the product of two vectors
differs from that of the quantised ones by at most |aq||r'| + |r||a'q'| + |r||r'|, norms that are
stored with each vector.

1. Vectors are dealt to tiles by the nearest of a bounded sample of centres.  Two centres so far
   apart, and with radii so small, that no two of their vectors can link have no pairs of tiles.
2. For every other pair of tiles the codes, scales and norms move, about an eighth of the doubles.
   Their products, whole numbers that single precision holds exactly, and the bounds tell which
   pairs surely link, which surely don't, and which are in doubt.
3. Rows that are in doubt with some row of the other tile are fetched as doubles, and all pairs
   among them are decided in double precision.

The comparison of all tiles is quadratic by nature; what moves is each tile once per other tile
that isn't far, so larger tiles move less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkscan.llm.bytesops import minimum_labels
from inkscan.llm.shared import components, cut

#: Vectors in a tile, and in the blocks within which a pair of tiles is multiplied.
TILE, BLOCK = 8192, 1024
#: Centres at most, of a sample of so many vectors.
CENTRES = 1024
THRESHOLD = 0.9


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of the quantised vectors and of the errors (rounded up)."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    near = codes * scale[:, None]
    return codes, scale, np.linalg.norm(near, axis=1) * (1 + 1e-12), np.linalg.norm(unit - near, axis=1) * (1 + 1e-12) + 1e-15


class Tile:
    """The quantised vectors of a tile, with their numbers and how many rows each stands for."""

    def __init__(self, ids: bytes, codes: bytes, norms: bytes, copies: bytes):
        self.ids, self.copies = np.frombuffer(ids, dtype="<i8"), np.frombuffer(copies, dtype="<i8")
        self.codes = np.frombuffer(codes, dtype=np.int8).reshape(len(self.ids), -1)
        self.scale, self.length, self.error = np.frombuffer(norms, dtype="<f8").reshape(3, -1)


def tile_links(x: Tile, y: Tile, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs of vectors of two tiles that surely link, and those in doubt; within one tile each pair once."""
    out: list[list[np.ndarray]] = [[np.zeros(0, dtype=np.int64)] for _ in range(4)]
    for i in range(0, len(x.ids), BLOCK):
        a = slice(i, i + BLOCK)
        # products of int8 codes are whole numbers under 2**24 for up to 1,000 dimensions: exact in single precision
        exact = np.float32 if x.codes.shape[1] <= 1000 else np.float64
        ca = x.codes[a].astype(exact)
        for j in range(i if same else 0, len(y.ids), BLOCK):
            b = slice(j, j + BLOCK)
            near = ca @ y.codes[b].astype(exact).T
            # near * scale_x * scale_y + bound >= threshold, with the bound's largest value first
            bound = x.length[a].max() * y.error[b].max() + x.error[a].max() * y.length[b].max() + x.error[a].max() * y.error[b].max()
            least = (threshold - bound - 1e-9) / (x.scale[a].max() * y.scale[b].max())
            p, q = np.nonzero(near >= exact(least - abs(least) * 1e-6) if least > 0 else np.ones(near.shape, dtype=bool))
            if same and i == j:
                p, q = p[q > p], q[q > p]
            if not len(p):
                continue
            value, p, q = near[p, q].astype(np.float64), p + i, q + j
            middle = value * x.scale[p] * y.scale[q]
            bound = x.length[p] * y.error[q] + x.error[p] * y.length[q] + x.error[p] * y.error[q]
            sure, maybe = middle - bound >= threshold + 1e-9, middle + bound >= threshold - 1e-9
            for k, (index, keep) in enumerate(((p, sure), (q, sure), (p, maybe & ~sure), (q, maybe & ~sure))):
                out[k].append(index[keep])
    return tuple(map(np.concatenate, out))


def exact_links(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of doubles with a cosine of at least the threshold; with ``same``, each pair once."""
    out: list[list[np.ndarray]] = [[np.zeros(0, dtype=np.int64)] for _ in range(2)]
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    for i in range(0, len(x), BLOCK):
        for j in range(i if same else 0, len(y), BLOCK):
            about = (x[i : i + BLOCK] / nx[i : i + BLOCK, None]) @ (y[j : j + BLOCK] / ny[j : j + BLOCK, None]).T
            p, q = np.nonzero(about >= threshold - 1e-9)
            p, q = p + i, q + j
            if same:
                p, q = p[q > p], q[q > p]
            for k in range(0, len(p), 1 << 16):
                s, t = p[k : k + (1 << 16)], q[k : k + (1 << 16)]
                hit = (x[s] * y[t]).sum(axis=1) / (nx[s] * ny[t]) >= threshold
                out[0].append(s[hit])
                out[1].append(t[hit])
    return np.concatenate(out[0]), np.concatenate(out[1])


def _numbers(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype="<f8").reshape(-1, dim)


def _pack(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per tile: numbers, codes, norms, counts, and apart from them the doubles."""
    dim, tile = key[0].as_py(), key[1].as_py()
    table = pa.Table.from_batches(list(batches))
    vectors = _numbers(table.column("v"), dim)
    codes, *norms = quantise(vectors / np.linalg.norm(vectors, axis=1)[:, None])
    blobs = [table.column("id").to_numpy().astype("<i8"), codes, np.stack(norms).astype("<f8"), table.column("copies").to_numpy().astype("<i8"), vectors]
    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([tile], pa.int64()), *(pa.array([b.tobytes()], pa.binary()) for b in blobs)], names=["dim", "tile", "ids", "codes", "norms", "copies", "raw"])


FOUND = "dim int, low long, high long, id long, links long, to long, mine binary, other binary"


def _found(dim: int, low: int, high: int, ids: np.ndarray, copies: np.ndarray, a: np.ndarray, b: np.ndarray, doubt: tuple[bytes, bytes] | None = None) -> Iterator[pa.RecordBatch]:
    """Linked rows and spanning edges of links between positions of ``ids``; one row more for what is in doubt."""
    degree = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))  # whole numbers under 2**53
    label = minimum_labels(len(ids), a, b)
    some, more = np.flatnonzero(degree), int(doubt is not None)
    n = len(some) + more
    add = lambda x: pa.array(x.tolist() + [None] * more, pa.int64())
    columns = [pa.array([dim] * n, pa.int32()), pa.array([low] * n, pa.int64()), pa.array([high] * n, pa.int64()), add(ids[some]), add(degree[some].astype(np.int64)), add(ids[label[some]])]
    columns += [pa.array([None] * len(some) + ([doubt[k]] if doubt else []), pa.binary()) for k in range(2)]
    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in FOUND.split(", ")])


def _centres(good: DataFrame, tiles: int) -> dict[int, np.ndarray]:
    """Per dimension, the directions of a few vectors: as many as tiles and at most ``CENTRES`` in all."""
    some = good.orderBy(F.xxhash64("id", "v")).limit(min(CENTRES, max(1, tiles))).select("dim", "v").toArrow()
    dims = some.column("dim").to_numpy()
    out = {}
    for d in np.unique(dims):
        v = np.array([x for x, k in zip(some.column("v").to_pylist(), dims, strict=True) if k == d])
        out[int(d)] = v / np.linalg.norm(v, axis=1)[:, None]
    return out


def _placed(good: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """``good`` with its nearest centre and the distance to it; -1 and 0 where its dimension has none."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            nearest, away = np.full(len(batch), -1, dtype=np.int32), np.zeros(len(batch))
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                if int(d) in centres:
                    v = _numbers(batch.column("v").take(pa.array(rows)), int(d))
                    product = (v / np.linalg.norm(v, axis=1)[:, None]) @ centres[int(d)].T
                    nearest[rows] = product.argmax(axis=1)
                    away[rows] = np.sqrt(np.maximum(0, 2 - 2 * product.max(axis=1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest), pa.array(away)], names=[*batch.schema.names, "centre", "away"])

    return good.mapInArrow(place, "id long, dim int, v array<double>, copies long, centre int, away double")


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """Per vector: vec_id, n_links (other vectors linked directly), component_id, kept.

    Vectors that are null, zero, or hold null or non-finite components link with nothing, as do
    those of different dimensions with each other.  Every input row gives a row; rows of one
    vec_id are vectors of their own that share the id.  A null vec_id links with nothing.  Equal rows are
    told by 128 bits of hash, compared once and counted, so any number of copies is one vector in one tile.
    """
    df = embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    # a power of two brings the largest component near 1: squares neither vanish nor overflow, and cosines stay
    top = F.array_max(F.transform("v", F.abs))
    usable = F.coalesce(F.col("id").isNotNull() & ~bad & (top > 0), F.lit(False))
    df = df.withColumn("usable", usable)
    rows = df.where("usable").select("id", F.size("v").alias("dim"), F.transform("v", lambda c: c / F.pow(F.lit(2.0), F.floor(F.log2(top)))).alias("v"))
    rows = rows.select("id", "dim", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit("second"), "v").alias("h2"))
    same = ["dim", "h1", "h2"]
    distinct = rows.groupBy(*same).agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("v").alias("v"))
    # a number for every distinct vector, written with it
    distinct = cut(distinct.withColumn("number", F.monotonically_increasing_id()))
    good = distinct.select(F.col("number").alias("id"), "dim", "v", "copies")
    centres = _centres(good, -(-good.count() // tile))
    placed = cut(_placed(good, centres))
    groups = cut(placed.groupBy("dim", "centre").agg(F.ceil(F.count("*") / tile).cast("long").alias("tiles"), F.max("away").alias("radius")))
    # which centres may have links with which: one row per centre, of which there are few, and per dimension without one
    radius = {(r["dim"], r["centre"]): r["radius"] for r in groups.where("centre >= 0").collect()}
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    near = []
    for (d, c), r in radius.items():
        gap = np.linalg.norm(centres[d] - centres[d][c], axis=1)
        near.append((d, c, [k for k in range(len(gap)) if (d, k) in radius and gap[k] - r - radius[d, k] <= reach]))
    near = embeddings.sparkSession.createDataFrame(near, "dim int, centre int, near array<int>")
    code = (F.col("centre") + 1).cast("long") * (1 << 24) + F.pmod(F.xxhash64("id"), F.col("tiles"))
    dealt = placed.join(groups.select("dim", "centre", "tiles"), ["dim", "centre"])
    packed = cut(dealt.select("dim", code.alias("tile"), "id", "v", "copies").groupBy("dim", "tile").applyInArrow(_pack, "dim int, tile long, ids binary, codes binary, norms binary, copies binary, raw binary"))

    def compare(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim, low, high = (k.as_py() for k in key)
        parts = {}
        for batch in batches:
            for row in batch.select(["tile", "ids", "codes", "norms", "copies"]).to_pylist():
                parts[row["tile"]] = Tile(row["ids"], row["codes"], row["norms"], row["copies"])
        x, y, same = parts[low], parts[high], low == high
        a, b, p, q = tile_links(x, y, threshold, same)
        # rows in doubt are decided anew among each other, so what is sure among them waits too
        mine, other = (np.union1d(p, q),) * 2 if same else (np.unique(p), np.unique(q))
        left, right = np.zeros(len(x.ids), dtype=bool), np.zeros(len(y.ids), dtype=bool)
        left[mine], right[other] = True, True
        keep = ~(left[a] & right[b])
        a, b = a[keep], b[keep]
        ids, copies = (x.ids, x.copies) if same else (np.concatenate([x.ids, y.ids]), np.concatenate([x.copies, y.copies]))
        doubt = (mine.astype("<i8").tobytes(), other.astype("<i8").tobytes()) if len(p) else None
        yield from _found(dim, low, high, ids, copies, a, b if same else b + len(x.ids), doubt)

    others = groups.select(F.col("dim").alias("d2"), F.col("centre").alias("c3"), F.col("tiles").alias("n2"))
    # of all but the doubles, once for every tile that isn't far
    slim = packed.select("dim", "tile", F.expr(f"cast(tile div {1 << 24} - 1 as int)").alias("centre"), "ids", "codes", "norms", "copies")
    reachable = groups.select("dim", "centre").join(near, ["dim", "centre"], "left").select("dim", "centre", F.explode(F.coalesce("near", F.array(F.lit(-1)))).alias("c2"))
    partner = reachable.join(others, (F.col("dim") == F.col("d2")) & (F.col("c2") == F.col("c3")))
    partner = partner.select(F.col("dim").alias("d2"), F.col("centre").alias("own"), F.explode(F.expr(f"transform(sequence(0L, n2 - 1), k -> (c2 + 1L) * {1 << 24} + k)")).alias("with"))
    pairs = slim.join(partner, (F.col("dim") == F.col("d2")) & (F.col("centre") == F.col("own"))).select(
        "dim", F.least("tile", "with").alias("low"), F.greatest("tile", "with").alias("high"), "tile", "ids", "codes", "norms", "copies"
    )
    first = cut(pairs.groupBy("dim", "low", "high").applyInArrow(compare, FOUND))
    doubts = first.where("mine is not null").select("dim", "low", "high", "mine", "other")
    sides = doubts.select("dim", "low", "high", F.explode(F.array(F.struct(F.col("low").alias("tile"), F.lit(0).alias("side"), F.col("mine").alias("pick")), F.struct(F.col("high").alias("tile"), F.lit(1).alias("side"), F.col("other").alias("pick")))).alias("s"))
    sides = sides.select("dim", "low", "high", "s.*").where("side = 0 or low <> high")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["ids", "copies", "raw"]
        for batch in batches:
            taken = {c: [] for c in names}
            for row in batch.select(["dim", "pick", *names]).to_pylist():
                at = np.frombuffer(row["pick"], dtype="<i8")
                for c in names[:2]:
                    taken[c].append(np.frombuffer(row[c], dtype="<i8")[at].tobytes())
                taken["raw"].append(np.frombuffer(row["raw"], dtype="<f8").reshape(-1, row["dim"])[at].tobytes())
            yield pa.RecordBatch.from_arrays([*map(batch.column, ("dim", "low", "high", "side")), *(pa.array(taken[c], pa.binary()) for c in names)], names=["dim", "low", "high", "side", *names])

    def decide(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim, low, high = (k.as_py() for k in key)
        parts = {row["side"]: row for batch in batches for row in batch.to_pylist()}
        same = low == high
        sides = [0] if same else [0, 1]
        v = {s: np.frombuffer(parts[s]["raw"], dtype="<f8").reshape(-1, dim) for s in sides}
        ids, copies = (np.concatenate([np.frombuffer(parts[s][c], dtype="<i8") for s in sides]) for c in ("ids", "copies"))
        a, b = exact_links(v[0], v[0] if same else v[1], threshold, same)
        yield from _found(dim, low, high, ids, copies, a, b if same else b + len(v[0]))

    fetched = sides.join(packed.select("dim", "tile", "ids", "copies", "raw"), ["dim", "tile"]).select("dim", "low", "high", "side", "pick", "ids", "copies", "raw")
    fetched = fetched.mapInArrow(pick, "dim int, low long, high long, side int, ids binary, copies binary, raw binary")
    second = fetched.groupBy("dim", "low", "high").applyInArrow(decide, FOUND)
    found = cut(first.where("mine is null").unionByName(second).select("id", "links", "to"))
    degrees = found.groupBy(F.col("id").alias("number")).agg(F.sum("links").alias("links"))
    # rows meet their vectors again; an id with several vectors joins what they link with
    numbers = cut(rows.select("id", *same).join(distinct.select(*same, "number", "copies"), same).select("id", "number", "copies"))
    several = numbers.groupBy("id").agg(F.min("number").alias("a"), F.max("number").alias("z")).where("a <> z").select("id", "a")
    shared = numbers.join(several, "id").select("a", F.col("number").alias("b"))
    label = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")).unionByName(shared))
    placed_in = distinct.select("number", "least").join(label.withColumnRenamed("id", "number"), "number", "left").select("number", "least", F.coalesce("label", "number").alias("part"))
    smallest = placed_in.groupBy("part").agg(F.min("least").alias("component"))
    component = placed_in.join(smallest, "part").select("number", "component")
    linked = numbers.join(degrees, "number", "left").join(component, "number").select("id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component")
    linked = cut(linked)
    # rows that link with nothing share the component of their id's other rows
    of_id = linked.groupBy("id").agg(F.min("component").alias("component"))
    alone = df.where(~F.col("usable") & F.col("id").isNotNull()).select("id").join(of_id, "id", "left").select("id", F.lit(0).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component"))
    every = linked.unionByName(alone).unionByName(df.where("id is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")))
    return every.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
