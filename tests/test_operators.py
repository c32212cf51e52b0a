"""Semantic micro-cases of functions and operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import sequences as S
from seqloom.operators import features, integrate, metrics, spatial


def one(spark, column, sql="SELECT 1 AS x"):
    return spark.sql(sql).select(column.alias("v")).first()["v"]


def test_sequence_functions(spark):
    assert one(spark, S.clean(F.lit(" ac\td\n"))) == "ACD"
    assert one(spark, S.aromaticity(F.lit("FWYA"))) == 0.75
    assert one(spark, S.gravy(F.lit("ACDE"))) == pytest.approx(-0.675)
    assert one(spark, S.tokens(F.lit("ACXY"))) == [1, 2, 21, 20]
    assert one(spark, S.one_hot(F.lit("E"))) == [0, 0, 0, 1, 0, 0, 0, 0]
    assert sum(one(spark, S.one_hot(F.lit(None).cast("string")))) == 0
    assert one(spark, S.truncate(F.lit("ABCDE"), 4)[0]) == "ABCD"
    assert one(spark, S.truncate(F.lit("ABCD"), 4)[1]) is False
    assert [one(spark, S.query_id(F.lit(x))) for x in ("sp|A|B", "tr|A|B", "A", "xx|A|B", "sp|A")] == ["A", "A", "A", "xx|A|B", "sp|A"]
    assert one(spark, S.prefix_key(F.lit(""))) == "?"
    p = one(spark, S.structure_percentages(F.array(*map(F.lit, S.STRUCTURE_CLASSES))))
    assert (p["helix"], p["sheet"], p["coil"]) == (37.5, 25.0, 37.5)
    assert one(spark, S.structure_percentages(F.array().cast("array<string>")))["helix"] is None


def test_properties(spark):
    p = one(spark, S.properties(F.lit("ACDEFGHIKL"), {"AC": 2.0}))
    assert p["molecular_weight"] == pytest.approx(sum(S.MASS[c] for c in "ACDEFGHIKL") + S.WATER)
    assert p["instability_index"] == pytest.approx(10 / 10 * (2.0 + 8 * 1.0))
    ph = p["isoelectric_point"]
    assert one(spark, S.net_charge(F.lit("ACDEFGHIKL"), float(ph))) == pytest.approx(0, abs=1e-6)
    assert set(one(spark, S.properties(F.lit("WXYZ"), {})).asDict().values()) == {0.0}


def test_finite(spark):
    values = [one(spark, S.finite(F.lit(x))) for x in ("1.5", "NaN", "Infinity", "no", None)]
    assert values == [1.5, None, None, None, None]
    assert one(spark, S.imputed(F.lit("NaN"))) == 0.0


@pytest.mark.parametrize(
    ("accession", "sheet", "gravy", "instability", "want"),
    [("PF00234", None, None, None, "yes"), ("PF1", 30.0, 0.0, 50.0, "no"), ("PF1", 30.01, None, None, "yes"), ("PF1", None, 0.1, 40.1, "yes"), ("PF1", None, 0.1, 40.0, "no"), ("PF1", None, None, 50.0, "no")],
)
def test_label(spark, accession, sheet, gravy, instability, want):
    d = F.array(F.struct(F.lit(accession).alias("accession")))
    s = F.array(F.struct(F.lit(sheet).cast("double").alias("sheet_percentage")))
    assert one(spark, integrate.label(d, s, F.lit(gravy).cast("double"), F.lit(instability).cast("double"))) == want


def test_moments(spark):
    rows = spark.createDataFrame([(1.0, 5.0, None), (float("nan"), 5.0, None), (3.0, 5.0, None), (None, 5.0, None)], "a double, b double, c double")
    m, s = features.moments([S.finite(F.col(c)) for c in "abc"])
    r = rows.agg(m.alias("m"), s.alias("s")).first()
    assert r["m"] == [2.0, 5.0, 0.0]
    assert r["s"] == [1.0, 1e-7, 1e-7]


def test_featurised_and_collated(spark):
    proteins = spark.createDataFrame([("P1", "ACX", 3, "Unknown", None), ("P2", "AC", 2, "Unknown", None)], "uniprot_id string, sequence string, sequence_length long, organism string, taxonomy_id string")
    hits = spark.sql("SELECT 'P1' AS uniprot_id, 'PF00190' AS accession, 4L AS start")
    shapes = spark.sql("SELECT 'P1' AS uniprot_id, 'b' AS pdb_id, 1D AS helix_percentage, 2D AS sheet_percentage, 3D AS coil_percentage, array(named_struct('relative_accessibility', 0.5D, 'phi', 1D, 'psi', 2D, 'secondary_structure', 'E')) AS dssp_residue_details")
    table = integrate.integrate(proteins, hits, shapes, {})
    f = {r["uniprot_id"]: r for r in features.featurised(table, features.stats(table)).collect()}
    assert f["P1"]["gelation"] == 1.0
    assert f["P2"]["gelation"] == 0.0
    assert [len(x) for x in f["P1"]["residue_features"]] == [14, 14, 14]
    assert len(f["P1"]["protein_features"]) == 13
    assert list(f["P1"]["residue_features"][0])[6:] == [0, 0, 0, 1, 0, 0, 0, 0]
    assert list(f["P1"]["residue_features"][1])[6:] == [0, 0, 0, 0, 0, 0, 0, 1]
    assert integrate.summary(table).first().asDict() == {"total": 2, "without_structure": 1, "labelled_yes": 1}
    indexed = features.featurised(table, features.stats(table)).withColumn("i", F.lit(0))
    got = features.collated(features.batches(indexed, "i", 4)).collect()
    assert {len(r["sequence"]) for r in got} == {7}
    assert {len(r["residue_features"]) for r in got} == {7}
    p = metrics.predict(features.featurised(table, features.stats(table)), metrics.Network.random(1, 4, 4, protein=4)).collect()
    assert all(0 <= r["probability"] <= 1 for r in p)  # a deviation at its floor saturates the score


def test_network_size():
    n = metrics.Network.random()
    assert n.parameters() == 108_961


def test_metrics(spark):
    df = spark.createDataFrame([(0.9, 1.0), (0.9, 0.0), (0.4, 1.0), (0.1, 0.0)], "s double, y double")
    assert metrics.auc(df, "s", "y").first()["auc"] == 0.625
    assert metrics.auc(df.where("y = 1"), "s", "y").first()["auc"] is None
    for z, y, want in ((0.0, 1.0, 0.693147), (2.0, 1.0, 0.126928), (2.0, 0.0, 2.126928)):
        assert one(spark, metrics.bce(F.lit(z), F.lit(y))) == pytest.approx(want, abs=1e-6)
    assert one(spark, metrics.predicted(F.lit(0.5))) == 0.0
    h = spark.createDataFrame([(1, 3.0), (2, 1.0), (3, 2.0)], "epoch int, val_loss double")
    assert [(r["best"], r["waited"]) for r in metrics.best_so_far(h).orderBy("epoch").collect()] == [(3.0, 0), (1.0, 0), (1.0, 1)]


def angles(spark, degrees):
    return spark.createDataFrame([(i, [math.cos(math.radians(a)), math.sin(math.radians(a))]) for i, a in enumerate(degrees)], "vec_id long, embedding array<double>")


def test_dbscan_and_split(spark):
    v = angles(spark, (0, 5, 10, 60))
    got = {r["id"]: r["cluster"] for r in spatial.dbscan(v, 0.006, 2).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: -1}
    got = {r["id"]: r["cluster"] for r in spatial.dbscan(v, 0.006, 3).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: -1}
    clusters = spark.createDataFrame([(i, i % 38 if i < 380 else -1) for i in range(400)], "id long, cluster long")
    split = spatial.cluster_split(clusters)
    sides = {tuple(r) for r in split.select("cluster", "split").distinct().collect()}
    assert sum(s == "test" for _, s in sides) == 8
    assert len(sides) == 38
    assert split.count() == 380
    only = spatial.cluster_split(clusters.where("cluster = 3"))
    assert {r["split"] for r in only.collect()} == {"train"}
    with pytest.raises(ValueError, match="test_ratio"):
        spatial.cluster_split(clusters, 1.0)
    with pytest.raises(ValueError, match="positive"):
        spatial.dbscan(v, 0.0)


def test_similarity_pairs_equal_brute_force(spark):
    x = np.random.default_rng(3).standard_normal((120, 6))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r["a"], r["b"]) for r in spatial.similarity_pairs(df, 0.1, pivots=8).collect()}
    assert got == {(i, j) for i in range(120) for j in range(i + 1, 120) if 1 - u[i] @ u[j] <= 0.1}


def test_embedding_and_pooling(spark):
    s = spark.createDataFrame([("P1", "ACDEFG"), ("P2", "")], "uniprot_id string, sequence string")
    got = metrics.embed(s, 16).collect()
    assert [len(r["embedding"]) for r in got] == [16]
    h = spark.sql("SELECT 'P1' AS uniprot_id, 2L AS sequence_length, array(array(9D), array(1D), array(3D), array(9D)) AS states UNION ALL SELECT 'P2', 0L, array(array(9D))")
    assert {r["uniprot_id"]: r["embedding"] for r in metrics.mean_pooled(h).collect()} == {"P1": [2.0], "P2": [0.0]}


def test_folded_states(spark):
    """Folds and merges equal the exploded form, missing values skipped; values of one kind deviate by exactly 0."""
    import random

    from seqloom.operators import moments

    rnd = random.Random(1)
    rows = [(i, [None if rnd.random() < 0.2 else rnd.gauss(1e9, 1) for _ in range(rnd.randint(0, 30))]) for i in range(500)] + [(900, []), (901, None), (902, [None])]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(7)
    one = moments.merge_rows(df.select(moments.folded(F.col("v")).alias("s"), F.struct(F.lit(1).cast("long").alias("n"), F.lit(2.5).alias("mean"), F.lit(0.0).alias("m2")).alias("same")), ["s", "same"]).first()
    values = [x for _, v in rows for x in v or () if x is not None]
    mean = sum(x - 1e9 for x in values) / len(values) + 1e9
    assert one["s"]["n"] == len(values)
    assert abs(one["s"]["mean"] - mean) < 1e-6
    assert abs(one["s"]["m2"] / sum((x - mean) ** 2 for x in values) - 1) < 1e-6
    assert tuple(one["same"]) == (503, 2.5, 0.0)
    for v in ("AAAAAAA", "GGG", "GGGGGGG", "WWWWWWW"):
        texts = spark.createDataFrame([(v,)] * 3, "s string").repartition(2)
        state = moments.merge_rows(texts.select(moments.folded(S.scale_values(F.col("s"), S.HYDROPATHY)).alias("s")), ["s"])
        assert state.select(moments.deviation_of(F.col("s"))).first()[0] == 0.0
    none = moments.merge_rows(df.limit(0).select(moments.folded(F.col("v")).alias("s")), ["s"]).select(moments.mean_of(F.col("s")), moments.deviation_of(F.col("s"), 1.0)).first()
    assert tuple(none) == (None, 1.0)


def test_residue_stats_equal_the_exploded_form(spark):
    details = [{"relative_accessibility": 0.5, "phi": -60.0, "psi": None}, {"relative_accessibility": None, "phi": float("nan"), "psi": 2.0}, {"relative_accessibility": 9.0, "phi": 9.0, "psi": 9.0}]
    feats = [{"hydrophobicity": 1.0, "polarity": 2.0, "volume": None}, {"hydrophobicity": -1.5, "polarity": 2.0, "volume": 0.0}]
    rows = [("a", 2, feats, [{"dssp_residue_details": details}]), ("b", 1, feats, []), ("c", None, feats, None), ("d", 0, feats, [{"dssp_residue_details": details}]), ("e", 9, None, [{"dssp_residue_details": None}])]
    kind = "uniprot_id string, sequence_length long, residue_features array<struct<hydrophobicity:double,polarity:double,volume:double>>, structural_features array<struct<dssp_residue_details:array<struct<relative_accessibility:double,phi:double,psi:double>>>>"
    df = spark.createDataFrame(rows, kind)
    got = features.residue_stats(df)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    r = got.first()
    want = {"hydrophobicity": [1.0, -1.5, 1.0], "polarity": [2.0, 2.0, 2.0], "volume": [0.0], "relative_accessibility": [0.5], "phi": [-60.0], "psi": [2.0]}
    for i, c in enumerate(features.RESIDUE):
        v = want[c]
        m = sum(v) / len(v)
        assert abs(r["residue_mean"][i] - m) < 1e-12
        assert abs(r["residue_std"][i] - max(1e-7, (sum((x - m) ** 2 for x in v) / len(v)) ** 0.5)) < 1e-12
