"""Centroid clustering against plain Python integers, in all three kinds of arithmetic, and on awkward inputs."""

import hashlib
import math
import random

import numpy as np
import pytest

from seqloom.llm import centroids as C

LONG = 1 << 63


def brute(rows, width, scale, k, rounds):
    kept = [(i, [math.floor(x) * scale if abs(x) >= 2**53 else math.floor(x * scale) for x in v], v) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[2]))
    cents = [r[1] for r in order[:k]]

    def assign():
        out = []
        for _, v, _ in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in cents]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        at = assign()
        for j in range(len(cents)):
            mine = [r[1] for r, (c, _) in zip(kept, at, strict=True) if c == j]
            if mine:
                cents[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    at = assign()
    fit = lambda v: v if v < LONG else None
    inertia = [sum(d for c, d in at if c == j) for j in range(len(cents))]
    return sorted(repr((r[0], c, fit(d), fit(inertia[c]), fit(sum(inertia)), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest())) for r, (c, d) in zip(kept, at, strict=True))


def vectors(size, n=120, width=6, seed=2):
    rnd = random.Random(seed)
    rows = [(i, [rnd.gauss(0, 1) * size for _ in range(width)]) for i in range(n)]
    rows += [(3, rows[3][1]), (4, rows[9][1]), (None, rows[5][1]), (None, [0.0] * width), (900, [0.5] * width), (901, [0.5] * width)]
    return rows + [(800, None), (801, []), (802, [1.0] * (width - 1)), (803, [1.0] * (width - 1) + [None]), (804, [float("nan")] * width), (805, [float("inf")] * width), (None, None)]


@pytest.mark.parametrize("size", [1.0, 1e6, 3e7, 1e9, 1e17, 1e30, 1e300])
def test_equals_python_integers(spark, size):
    rows = vectors(size)
    # A column of clashing name beside.
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string").repartition(5)
    got = C.clustered(df, width=6, k=7)
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(rows, 6, C.SCALE, 7, C.ROUNDS)


def test_blocks_of_mixed_sizes(spark):
    rows = [(i, v) for i, (_, v) in enumerate(vectors(1.0)[:60] + vectors(1e8, seed=4)[:40] + vectors(1e25, seed=5)[:20])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    assert sorted(repr(tuple(r)) for r in C.clustered(df, width=6, k=5).collect()) == brute(rows, 6, C.SCALE, 5, C.ROUNDS)


def test_few_and_no_vectors(spark):
    rows = [(1, [0.1, 0.2]), (2, [0.3, -0.4])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    as_float = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(repr(tuple(r)) for r in C.clustered(df, width=2).collect()) == brute(as_float, 2, C.SCALE, 16, 3)
    assert C.clustered(df.limit(0), width=2).count() == 0
    assert C.clustered(df, width=3).columns == ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_bounds_choose_the_arithmetic():
    """Just under the bound of float64 the expansion is exact; beyond it, integers give what Python's do."""
    rnd = np.random.default_rng(5)
    for most in (2**21, 2**23, 2**28, 2**40):
        x, c = rnd.integers(-most, most, (50, 64)), rnd.integers(-most, most, (9, 64))
        at, d = C.nearest(x, c)
        want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)), j) for j, s in enumerate(c)) for r in x]
        assert [(int(b), int(a)) for a, b in zip(at, d, strict=True)] == want
