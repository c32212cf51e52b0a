"""How often the range join copies points, and its pairs against brute force where cubes are cut."""

import itertools
import random

import pytest

from seqloom.operators import spatial


@pytest.mark.parametrize("most", [spatial.PAIRS, 3_000, 40])
def test_copies_and_pairs(spark, most):
    rnd = random.Random(3)
    points = [("p", i, *(rnd.uniform(0, 2.5) for _ in "xyz")) for i in range(300)]
    df = spark.createDataFrame(points, "structure_id string, index long, x double, y double, z double")
    left, right, _ = spatial.visits(df, 1.0, "structure_id", "index", most)
    assert right.count() == 300
    # 14 cubes a point; slabs no more than a cube's work takes.
    most_work = max(1, -(-300 * 300 // most))
    assert left.count() <= 14 * 300 * min(spatial.SLABS, most_work) and (most < 4_000_000 or left.count() == 14 * 300)
    want = {(a[1], b[1]) for a, b in itertools.combinations(points, 2) if sum((s - t) * (s - t) for s, t in zip(a[2:], b[2:], strict=True)) <= 1}
    got = [tuple(r)[1:] for r in spatial.range_pairs(df, 1.0, most=most).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_few_slabs_for_little_work(spark):
    """A cube with twice the pairs of a task is cut in two, not in 64."""
    df = spark.createDataFrame([("p", i, 0.5 + i / 1e4, 0.5, 0.5) for i in range(200)], "structure_id string, index long, x double, y double, z double")
    left, _, keys = spatial.visits(df, 1.0, "structure_id", "index", 20_000)
    assert "slab" in keys and left.where("own").count() == 2 * 200
