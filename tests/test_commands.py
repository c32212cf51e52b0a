"""Structures end to end, training, checkpoints and the commands."""

import json
import random
from pathlib import Path

import pytest

from seqloom import cli, schemas
from seqloom.operators import structures, training
from seqloom.sources import readers, sinks

REF = "DBREF  1ABC {}    1    90  UNP    {:<8} X_HUMAN          1     90"


def atom(serial, chain, seq, x):
    return f"ATOM  {serial:>5}  CA  ALA {chain}{seq:>4}    {x:>8.3f}{0.0:>8.3f}{0.0:>8.3f}  1.00  0.00           C"


@pytest.fixture
def shapes(tmp_path):
    folder = tmp_path / "pdb"
    folder.mkdir()
    (folder / "1abc.pdb").write_text("\n".join([REF.format("A", "P1"), REF.format("B", "P2"), *[atom(i, "A", i, 5.0 * i) for i in (1, 2, 3)], "ENDMDL", atom(9, "A", 9, 0.0)]) + "\n")
    (folder / "2abc.pdb").write_text("\n".join([REF.format("A", "P1"), atom(1, "A", 1, 0.0)]) + "\n")
    (folder / "3abc.pdb").write_text(atom(1, "A", 1, 0.0) + "\n")
    residues = tmp_path / "residues.json"
    rows = [{"pdb_id": "1abc", "chain": "A", "residue_seq": i, "secondary_structure": c, "phi": float("nan")} for i, c in ((3, "E"), (1, "H"), (2, "G"), (4, "-"))]
    residues.write_text("\n".join(map(json.dumps, rows)))
    return str(folder), str(residues)


def test_structures(spark, shapes):
    got = {(r["uniprot_id"], r["pdb_id"]): r for r in structures.read_structures(spark, *shapes).collect()}
    assert set(got) == {("P1", "1abc"), ("P2", "1abc"), ("P1", "2abc")}
    one, two = got["P1", "1abc"], got["P1", "2abc"]
    assert (one["helix_percentage"], one["sheet_percentage"], one["coil_percentage"], one["total_residues_dssp"]) == (50.0, 25.0, 25.0, 4)
    assert [r["residue_seq"] for r in one["dssp_residue_details"]] == [1, 2, 3, 4]
    assert one["dssp_residue_details"][0]["phi"] is None
    assert [tuple(c) for c in one["contact_map_indices_ca"]] == [(0, 1), (1, 2)]
    assert [c["x"] for c in one["ca_coordinates"]] == [5.0, 10.0, 15.0]
    assert [r["accession"] for r in one["dbref_records"]] == ["P1", "P2"]
    assert (one["processing_error"], one["pdb_file"]) == (None, "1abc.pdb")
    assert (two["processing_error"], two["total_residues_dssp"], two["helix_percentage"]) == (structures.NO_RESIDUES, 0, None)
    assert two["ca_coordinates"] == two["contact_map_indices_ca"] == two["dssp_residue_details"] == []


def dataset(spark, path, n, seed):
    """Sequences whose label follows their share of one residue."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        yes = i % 2 == 0
        s = "".join(r.choice("IIIIVL" if yes else "DDDEKR") for _ in range(r.randint(5, 40)))
        scale = [{"hydrophobicity": 4.5 if c in "IVL" else -3.5, "polarity": 0.0, "volume": 0.0} for c in s]
        rows.append({"uniprot_id": f"{'PQ'[i % 3 == 0]}{seed}{i}", "sequence": s, "sequence_length": len(s), "residue_features": scale, "gelation": "yes" if yes else "no", "structural_features": [], "domains": []})
    sinks.write_partitioned(spark.createDataFrame([{**dict.fromkeys(schemas.INTEGRATED.names), **x} for x in rows], schemas.INTEGRATED), path)


def text(path):
    return [line for f in sorted(Path(path).glob("part-*")) for line in f.read_text().splitlines()]


def test_train_save_load_evaluate_predict(spark, tmp_path):
    at = {k: str(tmp_path / k) for k in ("train", "val", "test", "stats", "out", "results", "report")}
    for seed, side in enumerate(("train", "val", "test")):
        dataset(spark, at[side], 40, seed)
    cli.main(["stats", "--input", at["train"], "--output", at["stats"]], spark)
    config = tmp_path / "config.yaml"
    config.write_text("epochs: 2\nbatch_size: 16\n")
    path = cli.main(["train", "--train", at["train"], "--val", at["val"], "--output", at["out"], "--stats", at["stats"], "--config", str(config), "--kind", "pooled"], spark)
    assert path.startswith(at["out"])
    assert path.endswith(("epoch=0-step=3.ckpt", "epoch=1-step=6.ckpt"))
    held = training.load(spark, path)
    assert (held.config.epochs, held.config.batch_size, held.config.kernel_sizes) == (2, 16, [3, 5, 7])
    table = readers.read_dataset(spark, at["test"])
    scores = training.evaluate(table, held).first()
    assert (scores["rows"], scores["accuracy"], scores["auc"]) == (40, 1.0, 1.0)
    cli.main(["evaluate", "--test", at["test"], "--model", path, "--results", at["report"]], spark)
    assert "accuracy: 1.0" in text(at["report"])
    cli.main(["predict", "--input", at["test"], "--model", path, "--results", at["results"]], spark)
    lines = [x.split("\t") for x in text(at["results"]) if not x.startswith("ID\t")]
    want = {r["uniprot_id"]: f"{r['probability']:.6f}" for r in training.predict(table, held).collect()}
    assert len(lines) == 40
    assert dict(lines) == want
    again = cli.main(["train", "--train", at["train"], "--val", at["val"], "--output", at["out"], "--model", path, "--kind", "pooled"], spark)
    assert again == path
    assert training.load(spark, again).model.coefficients == held.model.coefficients


def test_training_guards(spark, tmp_path):
    dataset(spark, str(tmp_path / "d"), 6, 5)
    table = readers.read_dataset(spark, str(tmp_path / "d"))
    from seqloom.operators import features

    stats = features.stats(table)
    with pytest.raises(ValueError, match="positive"):
        training.train(table, table, stats, readers.Config(epochs=0))
    with pytest.raises(ValueError, match="lack a class"):
        training.train(table.where("gelation = 'yes'"), table, stats, readers.Config(epochs=1))
    with pytest.raises(ValueError, match="no validation rows"):
        training.train(table, table.limit(0), stats, readers.Config(epochs=1))
    with pytest.raises(ValueError, match="isn't named"):
        training.load(spark, str(tmp_path / "model"))
    with pytest.raises(Exception, match="(?i)path"):
        training.load(spark, str(tmp_path / "epoch=1-step=1.ckpt"))


def test_split_and_extract(spark, tmp_path):
    dataset(spark, str(tmp_path / "d"), 40, 7)
    cli.main(["split", "--input", str(tmp_path / "d"), "--train", str(tmp_path / "train"), "--test", str(tmp_path / "test"), "--eps", "0.4", "--min-samples", "2", "--test-ratio", "0.5"], spark)
    sides = [{r["uniprot_id"] for r in spark.read.parquet(str(tmp_path / s)).select("uniprot_id").collect()} for s in ("train", "test") if (tmp_path / s).exists()]
    assert sides
    assert sum(map(len, sides)) == len(set().union(*sides)) <= 40
    (tmp_path / "AF-P1-F1-model_v4.pdb.gz").write_bytes(b"x")
    (tmp_path / "AF-P2-F1-model_v4.pdb.gz").write_bytes(b"x")
    (tmp_path / "ids.fasta").write_text(">sp|P2|X\nAC\n")
    cli.main(["extract", "--folder", str(tmp_path), "--fasta", str(tmp_path / "ids.fasta"), "--output", str(tmp_path / "paths")], spark)
    assert [x.rsplit("/", 1)[-1] for x in text(tmp_path / "paths")] == ["AF-P2-F1-model_v4.pdb.gz"]
    cli.main(["check", "--input", str(tmp_path / "d")], spark)
    with pytest.raises(ValueError, match="positive"):
        cli.main(["split", "--input", "x", "--train", "y", "--test", "z", "--max-len", "0"], spark)
