"""Similarity join and density clustering over the tree of balls, against brute force, with counts of what is compared."""

import math

import numpy as np
import pytest

from seqloom.operators import balls, spatial


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(a) for a in r]) for i, r in zip(ids if ids is not None else range(len(x)), x, strict=True)], "vec_id long, embedding array<double>").repartition(6)


def clustered(n=600, width=16, centers=12, spread=0.05, seed=3):
    rnd = np.random.default_rng(seed)
    c = rnd.standard_normal((centers, width))
    return c[rnd.integers(0, centers, n)] + spread * rnd.standard_normal((n, width))


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def brute_dbscan(x, ids, eps, m):
    u = unit(x)
    near = 1 - u @ u.T <= eps
    core = near.sum(axis=1) >= m
    root = {i: ids[i] for i in np.flatnonzero(core)}
    changed = True
    while changed:
        changed = False
        for i in root:
            low = min(root[j] for j in np.flatnonzero(near[i] & core))
            if low < root[i]:
                root[i], changed = low, True
    out = {}
    for i in range(len(x)):
        border = [root[j] for j in np.flatnonzero(near[i] & core)]
        out[ids[i]] = root[i] if core[i] else min(border) if border else -1
    return out


@pytest.mark.parametrize(("eps", "leaf"), [(0.02, 40), (0.3, 40), (0.6, 100), (0.1, 10_000)])
def test_pairs_equal_brute_force(spark, eps, leaf):
    x = clustered()
    x = np.vstack([x, x[:5], 3 * x[5:8]])
    u = unit(x)
    got = {(r["a"], r["b"]): r["distance"] for r in spatial.similarity_pairs(frame(spark, x), eps, leaf=leaf).collect()}
    d = 1 - u @ u.T
    want = {(i, j): d[i, j] for i in range(len(x)) for j in range(i + 1, len(x)) if d[i, j] <= eps}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_bounds_leave_few_pairs_to_compare(spark):
    x = clustered(2_000, centers=40)
    assert spatial.compared_pairs(frame(spark, x), 0.05, leaf=50) < 2_000**2 / 2 / 8


def test_equal_vectors_are_cut_by_hash(spark):
    x = np.tile(np.array([[1.0, 2.0, 3.0]]), (300, 1))
    df = frame(spark, x)
    assert spatial.similarity_pairs(df, 0.1, leaf=20).count() == 300 * 299 // 2
    tree = balls.tree(spatial.units(df), leaf=20)
    assert balls.blocks(tree.members, tree.leaves, 20, []).count() >= 10


def test_shuffled_blocks_give_the_same(spark, monkeypatch):
    df = frame(spark, clustered(300))
    want = {tuple(r)[:2] for r in spatial.similarity_pairs(df, 0.2, leaf=30).collect()}
    labels = {tuple(r) for r in spatial.dbscan(df, 0.2, 4, leaf=30).collect()}
    monkeypatch.setattr(balls, "BROADCAST_BYTES", 0)
    assert {tuple(r)[:2] for r in spatial.similarity_pairs(df, 0.2, leaf=30).collect()} == want
    assert {tuple(r) for r in spatial.dbscan(df, 0.2, 4, leaf=30).collect()} == labels


@pytest.mark.parametrize(("eps", "m", "leaf"), [(0.01, 4, 30), (0.05, 5, 40), (0.3, 3, 60), (0.004, 3, 25), (0.6, 8, 2_000)])
def test_dbscan_equals_brute_force(spark, eps, m, leaf):
    """Dense balls, borders and noise; ids near the ends of 64 bits."""
    rnd = np.random.default_rng(8)
    x = np.vstack([clustered(300, 6, 8, 0.08), rnd.standard_normal((60, 6)), np.tile(rnd.standard_normal((1, 6)), (70, 1)) + 1e-5 * rnd.standard_normal((70, 6))])
    ids = [(1 << 63) - 1 - 7 * i if i % 2 else -(1 << 63) + 3 * i for i in range(len(x))]
    got = {r["id"]: r["cluster"] for r in spatial.dbscan(frame(spark, x, ids), eps, m, leaf=leaf).collect()}
    assert got == brute_dbscan(x, ids, eps, m)


def test_dbscan_compares_few_pairs_in_dense_clusters(spark, monkeypatch):
    """10,000 near copies: compared pairs grow with the points, not with their square."""
    rnd = np.random.default_rng(2)
    copies = rnd.standard_normal((1, 8)) + 1e-4 * rnd.standard_normal((10_000, 8))
    x = np.vstack([copies, rnd.standard_normal((200, 8))])
    pairs, whole = [], balls.compared

    def watched(tree, found, *rest):
        pairs.extend((r["nx"], r["ny"]) for r in found.select("nx", "ny").collect())
        return whole(tree, found, *rest)

    monkeypatch.setattr(balls, "compared", watched)
    got = {r["id"]: r["cluster"] for r in spatial.dbscan(frame(spark, x), 0.05, 5, leaf=500).collect()}
    assert {got[i] for i in range(10_000)} == {0}
    assert sum(a * b for a, b in pairs) < 400 * len(x)


def test_empty_and_left_out_vectors(spark):
    df = spark.createDataFrame([(1, None), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert spatial.dbscan(df, 0.1, 2).count() == 0
    assert spatial.similarity_pairs(df, 0.1).count() == 0
    one = spark.createDataFrame([(1, None), (5, [0.0, 2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in spatial.dbscan(one, 0.1, 1).collect()] == [(5, 5)]
    assert [tuple(r) for r in spatial.dbscan(one, 0.1, 2).collect()] == [(5, -1)]


def test_components_of_large_ids(spark):
    ids = [9 * 10**18 + i for i in range(20)]
    nodes = spark.createDataFrame([(i,) for i in ids], "id long")
    edges = spark.createDataFrame([(ids[i], ids[i + 1]) for i in range(9)] + [(ids[15], ids[12])], "a long, b long")
    got = {r["id"]: r["root"] for r in spatial.components(nodes, edges).collect()}
    assert {got[i] for i in ids[:10]} == {ids[0]}
    assert (got[ids[15]], got[ids[13]]) == (ids[12], ids[13])
    assert math.isclose(spatial._reach(1.0), math.pi / 2)
