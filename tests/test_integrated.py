"""The queries without SQL take whole texts, against plain Python."""

import random

import pytest

from seqloom.functions import sequences as S
from seqloom.plans import catalog


def tables(spark, folder, texts, items=()):
    """documents and lineitem as the queries read them; items: (orderkey, partkey, suppkey, linenumber, quantity)."""
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double"
    spark.createDataFrame(list(items), schema).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_whole_texts(spark, tmp_path):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice(S.RESIDUES.lower() + " bé\n") for _ in range(n)) for n in (1, 40, 1022, 1400, 5000)]
    sf = tables(spark, tmp_path, texts)
    seqs = ["".join(c for c in t.upper() if c in S.RESIDUES) for t in texts]
    assert len(seqs[-1]) > 3 * S.MAX_LENGTH
    got = {r["doc_id"]: r for r in catalog.physicochemical_properties(spark, sf).collect()}
    for i, s in enumerate(seqs):
        if not s:
            continue
        pairs = sum(catalog.DIPEPTIDES.get(s[j : j + 2], 1.0) for j in range(len(s) - 1))
        assert got[i]["molecular_weight"] == pytest.approx(sum(S.MASS[c] for c in s) + S.WATER, abs=1e-5)
        assert got[i]["aromaticity"] == pytest.approx(sum(c in "FWY" for c in s) / len(s), abs=1e-5)
        assert got[i]["gravy"] == pytest.approx(sum(S.HYDROPATHY[c] for c in s) / len(s), abs=1e-5)
        assert got[i]["instability_index"] == pytest.approx(10 / len(s) * pairs, abs=1e-5)
    want = {str(i): (len(s), len(s)) for i, s in enumerate(seqs) if s}
    assert {r["uniprot_id"]: (r["n"], r["n_residues"]) for r in catalog.integrated_features(spark, sf).collect()} == want
    assert {r["uniprot_id"] for r in catalog.model_predictions(spark, sf).collect()} == set(want)


def test_every_line_item_is_a_hit_or_a_structure(spark, tmp_path):
    items = [(i, 10 * i + n, 100 - n, n, float(n)) for i in range(3) for n in range(1, 8) if i < 2 or n > 2]
    sf = tables(spark, tmp_path, ["ACDEFGHIKL"] * 4, items)
    got = {r["uniprot_id"]: r for r in catalog.integrated_table(spark, sf).collect()}
    assert set(got) == {"0", "1", "2", "3"}
    for i in range(4):
        mine = [x for x in items if x[0] == i]
        assert [d["start"] for d in got[str(i)]["domains"]] == sorted(p for _, p, _, n, _ in mine if n % 2)
        want = sorted((str(s), q) for _, _, s, n, q in mine if n % 2 == 0)
        assert [(x["pdb_id"], x["sheet_percentage"]) for x in got[str(i)]["structural_features"]] == want
