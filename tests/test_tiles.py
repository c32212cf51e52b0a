"""Blocks that aren't broadcast are shuffled once a tile, not once a pair of leaves."""

import numpy as np

from seqloom.operators import balls, spatial
from test_balls import brute_dbscan, frame


def test_tiles(spark, monkeypatch):
    x = np.random.default_rng(5).standard_normal((600, 8))
    ids = list(range(len(x)))
    want = {tuple(r)[:2] for r in spatial.similarity_pairs(frame(spark, x), 0.3, leaf=10).collect()}
    monkeypatch.setattr(balls, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(balls, "GROUPS", 3)
    copies = []
    whole = balls._tiles

    def counted(found, pairs):
        out = whole(found, pairs)
        sides = out.selectExpr("tile", "explode(array(x, y)) AS ball").distinct()
        copies.append((sides.join(found.leaves.select("ball", "n"), "ball").agg({"n": "sum"}).first()[0], found.leaves.count()))
        return out

    monkeypatch.setattr(balls, "_tiles", counted)
    for members in (100_000, 60):
        monkeypatch.setattr(balls, "GROUP_MEMBERS", members)
        assert {tuple(r)[:2] for r in spatial.similarity_pairs(frame(spark, x), 0.3, leaf=10).collect()} == want
    assert {r["id"]: r["cluster"] for r in spatial.dbscan(frame(spark, x, ids), 0.3, 4, leaf=20).collect()} == brute_dbscan(x, ids, 0.3, 4)
    assert all(leaves > 20 for _, leaves in copies)
    assert copies[0][0] <= 600 * 4 and copies[1][0] <= 600 * 11
