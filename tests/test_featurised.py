"""Features of residues made in numpy equal plain Python, and the integrated table is made once, of the rows that have a document."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import sequences as S
from seqloom.operators import features
from seqloom.plans import catalog
from test_integrated import tables

KIND = (
    "uniprot_id string, sequence string, sequence_length long, gelation string, domains array<struct<accession:string>>, "
    "physicochemical_properties struct<" + ",".join(f"{p}:double" for p in features.PROPERTIES) + ">, "
    "residue_features array<struct<hydrophobicity:double,polarity:double,volume:double>>, structural_features array<struct<helix_percentage:double,sheet_percentage:double,"
    "coil_percentage:double,dssp_residue_details:array<struct<relative_accessibility:double,phi:string,psi:double,secondary_structure:string>>>>"
)


def test_odd_lists(spark, monkeypatch):
    monkeypatch.setattr(features, "POSITIONS", 7)
    some = [(1.0, float("nan"), 2.0), None, (float("inf"), None, 3.0)]
    details = [(0.5, "1e1", None, "H"), None, (None, "n/a", -2.0, None), (1.0, "4", 5.0, "x"), (1.0, "4", 5.0, "-")]
    rows = [
        ("a", "ACDEX\U0001f600é", 7, "yes", [("PF00190",)], None, some, [(1.0, None, 2.0, details)]),
        ("b", "AC", 2, "no", None, (1.0, 2.0, 3.0, 4.0, 5.0, 6.0), [(1.0, 1.0, 1.0)] * 2, [(1.0, None, 2.0, None)]),
        ("c", "ayW", 3, None, [], None, None, None),
        ("d", "", 0, "yes", [], None, [], []), ("e", None, None, "yes", [], None, None, None),
    ]
    df = spark.createDataFrame(rows, KIND)
    stats = spark.createDataFrame([([0.5] * 13, [2.0] * 13, [0.25] * 6, [4.0] * 6)], "protein_mean array<double>, protein_std array<double>, residue_mean array<double>, residue_std array<double>")
    got = {r["uniprot_id"]: r for r in features.featurised(df, stats).collect()}
    assert set(got) == {"a", "b", "c"}
    number = lambda x: 0.0 if x is None or x == "n/a" or not math.isfinite(float(x)) else float(x)
    for name, seq, *_, residues, shapes in rows[:3]:
        assert list(got[name]["sequence"]) == [S.RESIDUES.find(c) + 1 or S.UNKNOWN for c in seq]
        assert len(got[name]["residue_features"]) == len(seq)
        more = (shapes[0][3] if shapes else None) or []
        for i, values in enumerate(got[name]["residue_features"]):
            r = residues[i] if residues and i < len(residues) and residues[i] else (None,) * 3
            d = more[i] if i < len(more) else None
            want = [(number(x) - 0.25) / 4.0 for x in (*r, *(d[:3] if d else (None,) * 3))]
            kind = "-" if d is None else d[3]
            assert list(values) == [*np.array(want, dtype=np.float32), *[float(kind == c) for c in S.STRUCTURE_CLASSES]]
    assert {r["uniprot_id"]: len(r["sequence"]) for r in features.featurised(df, stats, keep_empty=True).collect()} == {"a": 7, "b": 2, "c": 3, "d": 0, "e": 0}
    one = features.residue_stats(df).first()
    assert one["residue_mean"][4] == pytest.approx((10 + 4 + 4) / 3)


@pytest.mark.parametrize("query", ["integrated_features", "model_predictions"])
def test_integrated_once(spark, tmp_path, query):
    sf = tables(spark, tmp_path, ["ACDEFGHIKL"] * 2, [(i, 1, 1, n, 1.0) for i in range(50) for n in (1, 2)])
    out = catalog.QUERIES[query](spark, sf)
    files = out.inputFiles()
    assert files and not any("documents.parquet" in f or "lineitem.parquet" in f for f in files)
    assert out.count() == 2
    assert catalog.integrated_table(spark, sf).where(F.size("domains") == 1).count() == 2
