"""Look-ups by global number, structure files with faults, encoders, dense cubes and crowded scores."""

import gzip
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_commands import dataset

from seqloom import cli
from seqloom.functions import sequences as S
from seqloom.operators import encoding, metrics, spatial, structures
from seqloom.sources import readers


def test_rows_at_reads_only_files_that_hold_them(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.range(4_000).select("id", (F.col("id") * 2).alias("__row")).repartitionByRange(40, "id").write.parquet(path)
    whole = {r["global_index"]: r["id"] for r in readers.global_index(spark, path).collect()}
    assert sorted(whole) == list(range(4_000))
    chosen = random.Random(4).sample(range(1_500), 99)
    wanted = spark.createDataFrame([(i,) for i in [*chosen, chosen[0]]], "global_index long")
    got = readers.rows_at(spark, path, wanted)
    assert got.columns == ["id", "__row", "global_index"]
    rows = got.collect()
    assert sorted((r["global_index"], r["id"]) for r in rows) == sorted((i, whole[i]) for i in [*chosen, chosen[0]])
    plan = got._jdf.queryExecution().executedPlan()
    got.count()
    files = {r["file"] for r in readers.places(readers.file_counts(spark, path), wanted).collect()}
    assert 1 < len(files) < 40
    pruned = spark.read.parquet(path).where(F.col("_metadata.file_path").isin(sorted(files)))
    scan = pruned._jdf.queryExecution().executedPlan()
    pruned.write.format("noop").mode("overwrite").save()
    assert "file_path" in plan.toString() and "file_path" in scan.toString()
    assert {r["f"] for r in got.select("id").join(spark.read.parquet(path).select("id", F.col("_metadata.file_path").alias("f")), "id").collect()} == files


def test_rows_at_out_of_range(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.range(10).coalesce(1).write.parquet(path)
    for odd in (10, -1, None):
        wanted = spark.createDataFrame([(3,), (odd,)], "global_index long")
        with pytest.raises(IndexError):
            readers.rows_at(spark, path, wanted)
        assert [tuple(r) for r in readers.rows_at(spark, path, wanted, missing="skip").collect()] == [(3, 3)]
    assert readers.rows_at(spark, path, wanted.limit(0)).count() == 0


ATOM = "ATOM  {:>5}  CA  ALA A{:>4}    {:>8.3f}{:>8.3f}{:>8.3f}"
REF = "DBREF  1ABC A    5   120  UNP    {:<8} ABC_ARATH       25    140"


def test_faults_of_structure_files_are_rows(spark, tmp_path):
    good = "\r\n".join([REF.format("P1"), *[ATOM.format(i, i, 5 * i, 0, 0) for i in range(3)], "ENDMDL", ATOM.format(9, 9, 1, 1, 1)]) + "\r\n"
    folder = tmp_path / "s" / "deep" / "er"
    folder.mkdir(parents=True)
    (tmp_path / "s" / "good.PDB").write_text(good)
    (folder / "packed.pdb.gz").write_bytes(gzip.compress(good.replace("P1", "P2").encode()) + gzip.compress(b"END\n"))
    (folder / "short.pdb.gz").write_bytes(gzip.compress((good.replace("P1", "P3") + "REMARK x\n" * 20_000 + "".join(random.Random(1).choices("abcdef", k=9_000))).encode())[:-400])
    (folder / "broken.pdb").write_text(good.replace("P1", "P4").replace("   5.000", "  5.0.00"))
    (folder / "bytes.pdb").write_bytes(b"\xff\xfe\x00" + good.replace("P1", "P5").encode())
    (folder / "other.txt").write_text(good)
    (folder / "none.pdb.gz").write_bytes(b"no gzip")
    residues = tmp_path / "r.json"
    residues.write_text('{"pdb_id": "good", "chain": "A", "residue_seq": 1, "secondary_structure": "H"}\n')
    files = structures.read_files(spark, str(tmp_path / "s"))
    assert files._jdf.queryExecution().executedPlan().toString().count("FileScan binaryFile") == 1
    errors = {r["file"].rsplit("/", 1)[-1]: r["error"] for r in files.collect()}
    assert {k: v is not None for k, v in errors.items()} == {"good.PDB": False, "packed.pdb.gz": False, "short.pdb.gz": True, "broken.pdb": True, "bytes.pdb": False, "none.pdb.gz": True}
    assert errors["broken.pdb"] == "unreadable atom in line 3"
    got = {r["uniprot_id"]: r for r in structures.read_structures(spark, str(tmp_path / "s"), str(residues)).collect()}
    assert set(got) >= {"P1", "P2", "P3", "P4"}
    for k in ("P1", "P2"):
        assert [tuple(c) for c in got[k]["contact_map_indices_ca"]] == [(0, 1), (1, 2)]
        assert len(got[k]["ca_coordinates"]) == 3
    assert (got["P1"]["pdb_id"], got["P2"]["pdb_id"], got["P1"]["processing_error"]) == ("good", "packed", None)
    assert got["P2"]["processing_error"] == structures.NO_RESIDUES
    assert got["P4"]["processing_error"] == f"unreadable atom in line 3; {structures.NO_RESIDUES}"
    assert got["P3"]["processing_error"].startswith("unreadable file")
    assert got["P4"]["ca_coordinates"] == got["P3"]["ca_coordinates"] == []


def lengths(texts):
    """An encoder: length and first letter; fails on packs that hold an X."""
    if any("X" in t for t in texts):
        raise RuntimeError("no X")
    assert len(texts) * max(map(len, texts)) <= 64 or len(texts) == 1
    return np.array([[len(t), ord(t[0])] for t in texts], dtype=float)


def test_encoder_packs_and_failures(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(f"p{i}", "".join(rnd.choice("ACDE") for _ in range(rnd.randint(1, 40)))) for i in range(200)] + [("bad", "X" * 39), ("none", None), ("empty", ""), ("long", "A" * 500)]
    df = spark.createDataFrame(rows, "uniprot_id string, sequence string")
    encoder = encoding.find("test_lookups:lengths")
    one = {r["uniprot_id"]: r for r in encoding.encode(df.coalesce(1), encoder, cells=64, longest=100).collect()}
    many = {r["uniprot_id"]: r for r in encoding.encode(df.repartition(7).orderBy(F.desc("uniprot_id")), encoder, cells=64, longest=100).collect()}
    assert set(one) == set(many) == {k for k, v in rows if v}
    for k, v in rows:
        if v and one[k]["error"] is None and many[k]["error"] is None:
            assert list(one[k]["embedding"]) == list(many[k]["embedding"]) == [min(len(v), 100), ord(v[0])]
    assert "no X" in one["bad"]["error"] and one["bad"]["embedding"] is None
    assert sum(r["error"] is not None for r in one.values()) == 1
    assert one["long"]["truncated"] and not one["p1"]["truncated"]
    sizes = [1, 5, 9, 9, 30, 64, 500, 2]
    for pack in encoding.packs(sizes, 64):
        assert len(pack) == 1 or len(pack) * max(sizes[i] for i in pack) <= 64
    assert sorted(i for p in encoding.packs(sizes, 64) for i in p) == list(range(8))
    with pytest.raises(ValueError, match="module:function"):
        encoding.find("numpy")


def letters(texts):
    return np.array([[t.count(c) + 0.01 for c in "IVLDEK"] for t in texts], dtype=float)


def test_split_with_an_encoder(spark, tmp_path):
    dataset(spark, str(tmp_path / "d"), 30, 3)
    cli.main(["split", "--input", str(tmp_path / "d"), "--train", str(tmp_path / "a"), "--test", str(tmp_path / "b"), "--encoder", "test_lookups:letters", "--eps", "0.3", "--min-samples", "2", "--test-ratio", "0.5"], spark)
    sides = [{r["uniprot_id"] for r in spark.read.parquet(str(tmp_path / s)).collect()} for s in "ab"]
    assert all(sides) and not sides[0] & sides[1]


def test_range_join_with_half_the_points_in_one_cube(spark):
    rnd = np.random.default_rng(5)
    x = np.vstack([rnd.random((400, 3)) * 0.9, rnd.random((400, 3)) * 12])
    df = spark.createDataFrame([("s", i, *map(float, p)) for i, p in enumerate(x)] + [("s", 9_000, None, 1.0, 1.0), ("s", 9_001, float("nan"), 1.0, 1.0)], "structure_id string, index long, x double, y double, z double")
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    want = {(i, j) for i, j in zip(*np.nonzero(d <= 1), strict=True) if i < j}
    for most in (4_000_000, 20_000, 500):
        assert {(r["idx1"], r["idx2"]) for r in spatial.range_pairs(df, 1.0, most=most).collect()} == want
    # Work of the joined cubes: the largest is at most a few times the bound.
    rows = spatial.range_pairs(df, 1.0, most=20_000)
    assert rows.count() == len(want)


def test_auc_of_crowded_scores(spark):
    rnd = np.random.default_rng(1)
    s = np.concatenate([0.5 + 1e-6 * rnd.random(5_000), rnd.random(50), [np.inf, -np.inf, np.inf], 0.5 + 1e-7 * rnd.integers(0, 5, 500)])
    y = (rnd.random(len(s)) < 0.3 + 0.4 * (s > 0.5 + 5e-7)).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(s, y, strict=True)] + [(float("nan"), 1.0), (None, 1.0), (0.3, None)], "s double, y double")
    pos, neg = s[y > 0], s[y == 0]
    want = ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg))
    r = metrics.auc(df.repartition(5), "s", "y").first()
    assert (r["positives"], r["negatives"]) == (len(pos), len(neg))
    assert abs(r["auc"] - want) < 1e-12


def test_four_hundred_dipeptide_weights(spark, tmp_path):
    rnd = random.Random(6)
    weights = {a + b: round(rnd.uniform(-20, 60), 2) for a in S.RESIDUES for b in S.RESIDUES}
    (tmp_path / "w.tsv").write_text("".join(f"{k}\t{v}\n" for k, v in weights.items()))
    read = readers.read_weights(spark, str(tmp_path / "w.tsv"))
    assert read == weights
    texts = ["".join(rnd.choice(S.RESIDUES) for _ in range(n)) for n in (2, 30, 300)]
    got = spark.createDataFrame([(t,) for t in texts], "s string").select(S.dipeptide_index(F.col("s"), read).alias("v")).collect()
    for t, r in zip(texts, got, strict=True):
        assert abs(r["v"] - 10 / len(t) * sum(weights[t[i : i + 2]] for i in range(len(t) - 1))) < 1e-6


def test_store_check(spark, tmp_path):
    readers.check_store(spark, str(tmp_path))
    with pytest.raises(ConnectionError):
        readers.check_store(spark, str(tmp_path / "missing"))
