"""Scores of the integrated table are made in one pass, without a row or a list of values a residue in Spark, and equal those of the features."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import sequences as S
from seqloom.operators import features, integrate, metrics, network
from seqloom.plans import catalog
from test_integrated import tables

WEIGHTS = {"AC": 2.5, "CA": -1.25, "AA": 24.68, "XA": 3.0, "AX": 3.0}
ODD = ["A", "AAAAAAA", "ACDEX\U0001f600é", "ayW", "", None, "ACACAAAC" * 40, "WY" * 3, "GGGGÀGGG"]


def _joined(spark):
    rnd = random.Random(5)
    texts = [*ODD, *("".join(rnd.choice(S.RESIDUES) for _ in range(n)) for n in (2, 6, 7, 8, 90, 700))]
    rows = [(str(i), t, None if t is None else len(t) - (i == 2)) for i, t in enumerate(texts)]
    proteins = spark.createDataFrame(rows, "uniprot_id string, sequence string, sequence_length long")
    proteins = proteins.select("*", F.lit("x").alias("organism"), F.lit(None).cast("string").alias("taxonomy_id"))
    hits = spark.createDataFrame([("0", "PF00190", 5), ("6", "PF1", 2)], "uniprot_id string, accession string, start long")
    detail = "relative_accessibility:double,phi:string,psi:double,secondary_structure:string"
    details = [(0.5, "1e1", None, "H"), None, (None, "n/a", -2.0, None), (1.0, "4", float("inf"), "x"), (1.0, "4", 5.0, "-")]
    shapes = [(str(i), "p", 20.0, 10.0, 70.0, d) for i, d in ((0, details), (1, details[:2]), (6, details * 9), (8, None), (14, details * 100))]
    kind = f"uniprot_id string, pdb_id string, helix_percentage double, sheet_percentage double, coil_percentage double, dssp_residue_details array<struct<{detail}>>"
    return integrate.joined(proteins, hits, spark.createDataFrame(shapes, kind), WEIGHTS).cache()


def test_counted_equals_the_expression(spark):
    rows = _joined(spark).select("sequence", F.col("physicochemical_properties").alias("a"), S.properties(F.col("sequence"), WEIGHTS).alias("b")).collect()
    assert len(rows) == len(ODD) + 6
    for r in rows:
        assert r["a"] == r["b"], r["sequence"]


@pytest.mark.parametrize("volume", [None, {"A": 88.6, "é": 2.0, "X": float("inf"), "W": -3.5}])
def test_scored(spark, volume):
    table = _joined(spark)
    whole = integrate.with_residues(table, volume)
    a, b = features.stats(table, volume), features.stats(whole)
    for x, y in zip(a.first(), b.first(), strict=True):
        assert x == pytest.approx(y, rel=1e-12)
    pairs = zip(*(sorted(features.featurised(t, b, volume=volume).collect(), key=lambda r: r["uniprot_id"]) for t in (table, whole)), strict=True)
    assert all(x == y for x, y in pairs)
    net, rng = metrics.Network.random(1, 4, 4, kernels=(5, 3, 7), protein=4), np.random.default_rng(2)
    net.convolutions = [(k, rng.standard_normal(4), rng.standard_normal(4), rng.standard_normal(4)) for k, *_ in net.convolutions]
    want = {r["uniprot_id"]: r["logit"] for r in metrics.predict(features.featurised(whole, b), net).collect()}
    assert len(want) == len(ODD) - 2 + 6
    for t in (table, whole):
        assert {r["uniprot_id"]: r["logit"] for r in metrics.scored(t, b, net, volume).collect()} == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("limits", [(1 << 12, 1 << 12, 1 << 17), (16, 5, 1), (7, 1 << 12, 1000), (8, 1 << 12, 10)])
def test_kinds(monkeypatch, limits):
    for name, value in zip(("WINDOWS", "KINDS", "RUNS"), limits, strict=True):
        monkeypatch.setattr(network, name, value)
    rng, sizes = np.random.default_rng(3), np.array([1, 2, 7, 8, 9, 300, 3, 64, 6, 1])
    net, ends = metrics.Network.random(1, 4, 4, kernels=(5, 3, 7), protein=4), np.cumsum(sizes)
    net.convolutions = [(k, rng.standard_normal(4), rng.standard_normal(4), rng.standard_normal(4)) for k, *_ in net.convolutions]
    tokens, values, place, protein = rng.integers(1, 22, 12), rng.standard_normal((12, 14)), rng.integers(0, 12, ends[-1]), rng.standard_normal((len(sizes), 13))
    rows = [place[e - n : e] for n, e in zip(sizes, ends, strict=True)]
    want = net.logits([tokens[r] for r in rows], [values[r] for r in rows], protein)
    assert net.logits_of_kinds(place, tokens, values, sizes, protein) == pytest.approx(want, rel=1e-9)


def test_no_list_of_residue_values(spark, tmp_path):
    sf = tables(spark, tmp_path, ["acdefßghikl b", "", None, "bjoux"], [(i, 1, 1, n, 1.0) for i in range(2) for n in (1, 2)])
    assert {r["uniprot_id"]: r["sequence"] for r in catalog.integrated_table(spark, sf).collect()} == {"0": "ACDEFSSGHIKL"}
    out = catalog.model_predictions(spark, sf)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "residue_features" not in plan and plan.count("MapInArrow") == 3  # two for the statistics, one for the scores
    assert [r["uniprot_id"] for r in out.collect()] == ["0"]
