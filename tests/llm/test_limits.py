"""Operators with their limits at 0 or tiny: the shuffled ways give what the broadcast ones give. Clashing names, empty tables, held-out recall."""

import collections

import numpy as np
import pytest
from test_clashes import SF, frames, rows

from seqloom.llm import alignment, ann, common, line_dedup, queries, warc
from seqloom.llm.common import components

NAMES = "sid g pos end t block row rank query_id score zone piece t bucket v start ids_crc32 crc copy named told payload head body rest file offset next record_type refers_to words word_hits n_hit items spans contaminated cluster distance inertia raw item n_a groups codes rare at k1".split()
QUICK = ["op1_line_dedup", "op4_mix_sources", "op6_warc", "op7_url_filter", "op8_nearest", "op10_ngram_join", "op11_align", "op12_decontaminate", "op13_centroids"]


def tables(spark, folder, extra=(), empty=False):
    frames(spark, folder, extra, empty)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    for n in extra:
        if n not in bench.columns:
            bench = bench.withColumn(n, bench["item_id"] * 0)
    (bench.limit(0) if empty else bench).coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def want(spark):
    return {name: rows(queries.QUERIES[name](spark, SF)) for name in QUICK}


@pytest.mark.parametrize("name", QUICK)
def test_limits_change_nothing(spark, monkeypatch, want, name):
    for module, limits in ((common, {"BROADCAST_ROWS": 0, "BROADCAST_BYTES": 0}), (warc, {"BROADCAST_LINKS": 0}), (ann, {"QUERY_BLOCK": 3, "PIECE": 50}), (line_dedup, {"HOT_TIMES": 2, "HOT_LINES": 5}), (alignment, {"SMALL_GROUP": 2, "GATHERED": 10, "COUNTED": 50})):
        for limit, value in limits.items():
            monkeypatch.setattr(module, limit, value)
    # Defaults are bound when a function is made.
    monkeypatch.setattr(common.sized, "__defaults__", (0,))
    monkeypatch.setattr(common.sized_texts, "__defaults__", (0, 0))
    got = rows(queries.QUERIES[name](spark, SF))
    if name == "op8_nearest":  # more pieces, other buckets: each query's finds are as many
        assert len(got) == len(want[name])
    else:
        assert got == want[name]


@pytest.mark.parametrize("name", ["op3_token_files", "op6_warc", "op8_nearest", "op9_shards", "op11_align", "op12_decontaminate", "op13_centroids"])
def test_extra_columns_change_nothing(spark, tmp_path_factory, want, name):
    folder = tables(spark, tmp_path_factory.mktemp("wide"), NAMES)
    assert rows(queries.QUERIES[name](spark, folder)) == (want.get(name) or rows(queries.QUERIES[name](spark, SF)))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables_give_no_rows(spark, tmp_path, name):
    assert queries.QUERIES[name](spark, tables(spark, tmp_path, empty=True)).count() == 0


def test_components_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 90), (90, 95), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert {got[i] for i in range(21)} == {0}
    assert (got[90], got[95], got[100]) == (90, 90, 90)


def test_recall_of_held_out_queries(spark):
    rnd = np.random.default_rng(12)
    x = rnd.standard_normal((20_000, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(8)
    got = collections.defaultdict(set)
    for r in ann.nearest(df, 20).select("query_id", "vec_id").collect():
        got[r["query_id"]].add(r["vec_id"])
    assert len(got) == 1_000
    m = x.astype(np.float64)
    hits = 0
    for q, found in got.items():
        s = m @ m[q]
        s[q] = -np.inf
        hits += len(found & set(np.argpartition(-s, 20)[:20].tolist()))
    assert hits >= 0.9 * 20 * 1_000


def test_an_id_of_several_vectors(spark):
    x = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 0.1]), (1, [0.1, 3.0]), (2, [0.5, 0.5]), (3, [-1.0, -1.0])]
    got = [tuple(r) for r in ann.nearest(spark.createDataFrame(x, "vec_id long, embedding array<double>"), 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 3.0), (0, 2, 2, 0.5), (0, 3, 3, -1.0)]


def test_hot_line_in_every_document(spark):
    docs = spark.createDataFrame([(i, f"this line stands in every document\nline {i} alone in here x{i * 7919}x") for i in range(400)], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in line_dedup.deduped(docs, exact=1).collect()}
    assert out[0].startswith("this line stands")
    assert all("every document" not in t for i, t in out.items() if i)


