import numpy as np
import pytest

from inkscan.llm import embed_dedup


def brute(rows, threshold=0.9):
    ok = [(i, np.array(v, dtype=float)) for i, (k, v) in enumerate(rows) if k is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links, least = [0] * len(rows), {k: k for k, _ in rows}
    edges = []
    for x, (i, a) in enumerate(ok):
        for j, b in ok[x + 1 :]:
            if len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                links[i] += 1
                links[j] += 1
                edges.append((rows[i][0], rows[j][0]))
    for _ in range(len(rows)):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    return sorted(((k, n, least[k], k == least[k] or k is None) for (k, _), n in zip(rows, links, strict=True)), key=str)


@pytest.mark.parametrize("tile", [8192, 40])
def test_as_brute_force(spark, tile):
    rng = np.random.default_rng(tile)
    base = rng.normal(size=(25, 8))
    v = base[rng.integers(0, 25, 150)] + rng.normal(size=(150, 8)) * rng.choice([0.0, 0.2, 0.35], 150)[:, None]
    v *= 10.0 ** rng.integers(-3, 4, 150)[:, None]
    rows = [(int(i * 31 % 1009), x.tolist()) for i, x in enumerate(v)]
    rows += [(5000, None), (5001, [0.0] * 8), (5002, [None] + [1.0] * 7), (5003, [float("nan")] * 8), (5004, [float("inf")] * 8), (5005, []), (5006, [1.0, 2.0]), (5007, [1.0, 2.1])]
    rows += [(rows[0][0], rows[0][1]), (rows[1][0], None), (None, rows[0][1]), (6000, rows[3][1]), (6001, [1e-300] * 8), (6002, [1e300] * 8)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, tile int")
    got = embed_dedup.near_vectors(df, tile=tile).collect()
    want = brute([(k, [x / 2.0**900 for x in v] if k == 6002 else [x * 2.0**900 for x in v] if k == 6001 else v) for k, v in rows])
    assert sorted((tuple(r) for r in got), key=str) == want
    assert sum(r[1] for r in want) > 100


def test_no_rows(spark):
    assert embed_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_bounds_hold():
    rng = np.random.default_rng(0)
    unit = rng.normal(size=(300, 64))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    codes, scale, length, error = embed_dedup.quantise(unit)
    near = (codes.astype(float) @ codes.T.astype(float)) * scale[:, None] * scale
    bound = length[:, None] * error + error[:, None] * length + error[:, None] * error
    assert (np.abs(unit @ unit.T - near) <= bound + 1e-12).all()


def test_many_equal_rows(spark):
    """Forty thousand copies of one vector, with some near and some far, are one vector of one tile."""
    n = 40_000
    copies = spark.range(n).selectExpr("id as vec_id", "transform(array(1.0D, 2.0D, 3.0D), x -> x * pow(2.0D, cast(id % 3 as double))) as embedding")
    others = spark.createDataFrame([(n, [1.0, 2.0, 3.1]), (n + 1, [-3.0, 1.0, 0.0]), (5, [-3.0, 1.0, 0.01]), (7, None), (n + 2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = embed_dedup.near_vectors(copies.unionByName(others), tile=16).collect()
    assert len(got) == n + 5
    by = {}
    for r in got:
        by.setdefault(r.vec_id, set()).add((r.n_links, r.component_id, r.kept))
    # id 5 has a copy and a vector that links with n + 1, so all of these are one component
    assert by[0] == {(n, 0, True)} and by[1] == {(n, 0, False)} and by[n] == {(n, 0, False)}
    assert by[5] == {(n, 0, False), (1, 0, False)} and by[n + 1] == {(1, 0, False)}
    assert by[7] == {(n, 0, False), (0, 0, False)} and by[n + 2] == {(0, n + 2, True)}
