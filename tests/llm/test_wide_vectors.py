"""Vectors on which hashing stays under its recall are searched exactly."""

import collections
import logging

import numpy as np

from seqloom.llm import ann


def test_wide_uneven_vectors_are_searched_exactly(spark, caplog):
    r = np.random.default_rng(2)
    x = r.standard_normal((1500, 384))
    x *= (r.lognormal(0, 1, 1500) / np.linalg.norm(x, axis=1))[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    with caplog.at_level(logging.WARNING, "seqloom.llm.ann"):
        got = collections.defaultdict(list)
        for q in ann.nearest(df, 20).orderBy("query_id", "rank").collect():
            got[q["query_id"]].append(q["vec_id"])
    for i in range(0, 1500, 20):
        s = x @ x[i]
        s[i] = -np.inf
        assert got[i] == np.argsort(-s, kind="stable")[:20].tolist()
    assert set(got) == set(range(0, 1500, 20))
    assert "searched exactly" in caplog.text
