"""Readers and sinks on hand-made files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from seqloom import schemas
from seqloom.sources import readers, sinks

RECORDS = """ID   TEST1_PLANT   Reviewed;   6 AA.
AC   P11111; Q99999;
OS   Testus
OS   plantus.
OX   NCBI_TaxID=3702;
SQ   SEQUENCE   6 AA;  600 MW;  0 CRC64;
     ACDEFG 6
//
ID   TEST2_PLANT   Reviewed;   4 AA.
AC   P22222;
SQ   SEQUENCE   4 AA;
     WXYZ
//
ID   NOSEQ
AC   P33333;
//
ID   TEST1B
AC   P11111;
SQ   SEQUENCE   3 AA;
     AAA
//
ID   UNTERMINATED
AC   P44444;
SQ   SEQUENCE   3 AA;
     CCC
"""

DOMAINS = """# comment
Cupin_1 PF00190.25 149 sp|P12345|Generated - 350 1.2e-30 105.3 0.1 1 1 2.0e-33 3.0e-30 104.0 0.1 3 148 40 190 38 192 0.95 Cupin domain
too few fields
Bad PF1.1 1 Q1 - 1 x 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 d
"""


def test_records(spark, tmp_path):
    (tmp_path / "a.dat").write_text(RECORDS)
    got = {r["uniprot_id"]: r for r in readers.read_records(spark, str(tmp_path / "a.dat")).collect()}
    assert set(got) == {"P11111", "P22222"}
    assert (got["P11111"]["sequence"], got["P11111"]["organism"], got["P11111"]["taxonomy_id"]) == ("AAA", "Unknown", None)
    assert (got["P22222"]["sequence"], got["P22222"]["sequence_length"]) == ("WXYZ", 4)
    (tmp_path / "b.dat").write_text(RECORDS.split("//")[0] + "//\n")
    (r,) = readers.read_records(spark, str(tmp_path / "b.dat")).collect()
    assert (r["sequence"], r["organism"], r["taxonomy_id"]) == ("ACDEFG", "Testus plantus.", "3702")


@pytest.mark.parametrize(("column", "accession"), [(1, "PF00190"), (0, "Cupin_1")])
def test_domains(spark, tmp_path, column, accession):
    (tmp_path / "d.txt").write_text(DOMAINS)
    (r,) = readers.read_domains(spark, str(tmp_path / "d.txt"), column).collect()
    assert (r["uniprot_id"], r["accession"], r["description"]) == ("P12345", accession, "Cupin domain")
    assert (r["evalue"], r["score"], r["bias"]) == (1.2e-30, 105.3, 0.1)
    assert (r["hmm_start"], r["hmm_end"], r["start"], r["end"], r["envelope_start"], r["envelope_end"]) == (3, 148, 40, 190, 38, 192)


def test_cross_references_and_alpha_carbons(spark, tmp_path):
    atom = "ATOM  {:>5} {:<4} ALA A{:>4}    {:>8.3f}{:>8.3f}{:>8.3f}"
    lines = ["DBREF  1ABC A    5   120  UNP    P12345   ABC_ARATH       25    140", "DBREF  1ABC A    5   120  GB     P12345   ABC_ARATH       25    140"]
    lines += [atom.format(i, " CA", i, x, y, 0) for i, (x, y) in enumerate([(0, 0), (3.8, 0), (8, 0), (8, 8.1)])] + ["ENDMDL", atom.format(9, " CA", 9, 1, 1, 1)]
    (tmp_path / "s.pdb").write_text("\n".join(lines) + "\n")
    (tmp_path / "one.pdb").write_text(atom.format(1, " CA", 1, 0, 0, 0) + "\n")
    (r,) = readers.read_cross_references(spark, str(tmp_path)).collect()
    assert tuple(r)[1:] == ("A", "P12345", "ABC_ARATH", 5, 120, 25, 140)
    from seqloom.operators.spatial import range_pairs

    points = readers.read_alpha_carbons(spark, str(tmp_path)).withColumn("structure_id", F.col("file"))
    assert points.count() == 4
    assert {tuple(r) for r in range_pairs(points).select("idx1", "idx2").collect()} == {(0, 1), (0, 2), (1, 2)}


def test_fasta_and_file_names(spark, tmp_path):
    (tmp_path / "f.fasta").write_text(">sp|P1|X\nACDE\n>tr|Q2|Y\n>nobar\n")
    ids = readers.read_fasta_ids(spark, str(tmp_path / "f.fasta"))
    assert {r[0] for r in ids.collect()} == {"P1", "Q2"}
    names = ["AF-P1-F1-model_v4.pdb.gz", "af-P1-f1-MODEL_v4.PDB.GZ", "AF-p1-F1-model_v4.pdb.gz", "AF-P1-F1-model_v4.pdb", "AF-P9-F1-model_v4.pdb.gz"]
    files = spark.createDataFrame([(n,) for n in names], "path string")
    assert {r["path"] for r in readers.matching_files(files, ids).collect()} == set(names[:2])
    for n in ("x.PDB", "y.pdb", "z.txt"):
        (tmp_path / "tree").mkdir(exist_ok=True)
        (tmp_path / "tree" / n).write_text("x")
    assert readers.list_files(spark, str(tmp_path / "tree")).count() == 2
    with gzip.open(tmp_path / "g.pdb.gz", "wt") as f:
        f.write("one\ntwo\n")
    assert [r["value"] for r in readers.read_compressed_text(spark, str(tmp_path / "g.pdb.gz")).collect()] == ["one", "two"]


def test_keyed_json_and_partitions(spark, tmp_path):
    text = '{"P1": {"sequence": "AC", "structural_features": [{"helix_percentage": NaN, "contact_map_indices_ca": [{"idx": 1, "idx2": 2}]}]}, "": {"sequence": "G"}, "0x": {}, "bad": 3}'
    (tmp_path / "k.json").write_text(text)
    rows = readers.read_keyed_json(spark, str(tmp_path / "k.json"))
    got = {r["uniprot_id"]: r for r in rows.collect()}
    assert set(got) == {"P1", "", "0x"}
    assert got[""]["uniprot_id_prefix"] == "?"
    first = got["P1"]["structural_features"][0]
    assert first["helix_percentage"] is None
    assert tuple(first["contact_map_indices_ca"][0]) == (None, 2)
    sinks.write_partitioned(rows.where("uniprot_id = '0x'"), str(tmp_path / "out"))
    back = readers.read_dataset(spark, str(tmp_path / "out"), uniprot_id="0x")
    assert back.schema["uniprot_id_prefix"].dataType.simpleString() == "string"
    assert back.count() == 1
    assert sinks.write_subset(rows, spark.createDataFrame([("P1",)], "uniprot_id string"), str(tmp_path / "sub"))
    assert not sinks.write_subset(rows, spark.createDataFrame([("none",)], "uniprot_id string"), str(tmp_path / "none"))
    assert spark.read.parquet(str(tmp_path / "sub")).columns == schemas.INTEGRATED.fieldNames()


def test_global_index_of_files(spark, tmp_path):
    for i, n in enumerate((3, 0, 2)):
        spark.range(n).coalesce(1).write.parquet(str(tmp_path / f"d/{i}"))
    path = str(tmp_path / "d/*")
    got = readers.global_index(spark, path).orderBy("global_index").collect()
    assert [r["global_index"] for r in got] == [0, 1, 2, 3, 4]
    assert [r["id"] for r in got] == [0, 1, 2, 0, 1]


def test_config_and_stats(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("embed_dim: 32\nkernel_sizes: [3, 5]\ndropout: 0.1\n")
    c = readers.load_config(str(tmp_path / "c.yaml"))
    assert (c.embed_dim, c.kernel_sizes, c.dropout, c.num_filters) == (32, [3, 5], 0.1, 64)
    (tmp_path / "bad.yaml").write_text("what: 1\n")
    with pytest.raises(TypeError):
        readers.load_config(str(tmp_path / "bad.yaml"))
    stats = {"protein_mean": [0.0] * 13, "protein_std": [1.0] * 13, "residue_mean": [0.0] * 6, "residue_std": [1.0] * 6}
    (tmp_path / "s.json").write_text(json.dumps(stats))
    df = readers.read_stats(spark, str(tmp_path / "s.json"))
    sinks.write_stats(df, str(tmp_path / "again"))
    assert readers.read_stats(spark, str(tmp_path / "again")).first().asDict() == stats
    (tmp_path / "less.json").write_text('{"protein_mean": []}')
    with pytest.raises(ValueError, match="lacks"):
        readers.read_stats(spark, str(tmp_path / "less.json"))


def test_text_sinks(spark, tmp_path):
    df = spark.createDataFrame([("P1", "AC", 0.5)], "uniprot_id string, sequence string, probability double")
    sinks.write_fasta(df, str(tmp_path / "f"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "f")).collect()] == [">sp|P1|Generated", "AC"]
    sinks.write_predictions(df, str(tmp_path / "p"))
    back = spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "p"))  # each file has the header
    assert (back.columns, [tuple(r) for r in back.collect()]) == (["ID", "Gelation_Probability"], [("P1", "0.500000")])
    sinks.write_report(spark.sql("SELECT 0.5D AS accuracy, CAST(NULL AS DOUBLE) AS auc"), str(tmp_path / "r"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "r")).collect()] == ["accuracy: 0.5", "auc: n/a"]
    sinks.write_json_lines(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1
    sinks.write_embeddings(spark.sql("SELECT 'P1' AS uniprot_id, array(1.0D) AS embedding"), str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).schema["embedding"].dataType.simpleString() == "array<float>"


def test_records_hold_slashes_and_last_lines(spark, tmp_path):
    one = "ID   A\nCC   see https://a.org//b\n//x is no end\nAC   P1;\nSQ   SEQUENCE\n     AAA\n//\n"
    two = "//\n//\nAC   P2;\nSQ   SEQUENCE\n     CCC\n//"
    tail = "AC   P3;\nSQ   SEQUENCE\n     DDD"
    for name, text in (("a", one + two), ("b", one.replace("P1", "P4") + tail), ("c", one.replace("P1", "P5"))):
        (tmp_path / f"{name}.dat").write_text(text)
    with gzip.open(tmp_path / "d.dat.gz", "wt") as f:
        f.write(one.replace("P1", "P6") + two.replace("P2", "P7"))
    with gzip.open(tmp_path / "e.dat.gz", "wt") as f:
        f.write(one.replace("P1", "P8") + tail)
    got = {r["uniprot_id"]: r["sequence"] for r in readers.read_records(spark, str(tmp_path)).collect()}
    assert got == {"P1": "AAA", "P2": "CCC", "P4": "AAA", "P5": "AAA", "P6": "AAA", "P7": "CCC", "P8": "AAA"}


def test_records_of_many_blocks(spark, tmp_path):
    rows = [f"ID   X\nAC   P{i % 500};\nSQ   SEQUENCE\n     {'ACDEF' * (i % 7 + 1)}\n//\n" for i in range(2000)]
    (tmp_path / "many.dat").write_text("".join(rows))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7kb")
    try:
        got = {r["uniprot_id"]: r["sequence_length"] for r in readers.read_records(spark, str(tmp_path / "many.dat")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {f"P{i % 500}": 5 * (i % 7 + 1) for i in range(2000)}


@pytest.mark.parametrize("partitions", ["8", "64"])
def test_numbered_wide_rows(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        key = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
        li = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
        out = readers.numbered(li, key)
        n, count, low, high = out.agg(F.countDistinct("global_index"), F.count("*"), F.min("global_index"), F.max("global_index")).first()
        assert (n, count, low, high) == (li.count(), li.count(), 0, li.count() - 1)
        rows = out.orderBy("global_index").select(*key).collect()
        assert rows == sorted(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_config_lists_and_strings(spark, tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("# settings\nkernel_sizes:\n  - 3\n  - 9 # wide\nlr: 0.01\nepochs: 3\n")
    c = readers.load_config(str(p))
    assert (c.kernel_sizes, c.lr, c.epochs) == ([3, 9], 0.01, 3)
    assert readers._scalar("bare text") == "bare text"
    assert readers._scalar("[1, two]") == [1, "two"]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("packed", [False, True])
def test_records_of_any_line_ends(spark, tmp_path, end, packed):
    """CRLF files give what LF files give; lines that only start with slashes end no record; so for compressed files."""
    text = RECORDS.replace("OS   Testus\n", "OS   Testus\n//no end\n")
    for i, body in enumerate((text, text.replace("P22222", "P55555") + "//", "//\n//\n" + text.replace("P22222", "P66666") + "//\n")):
        raw = body.replace("\n", end).encode()
        (tmp_path / (f"{i}.dat.gz" if packed else f"{i}.dat")).write_bytes(gzip.compress(raw) if packed else raw)
    got = {r["uniprot_id"]: r for r in readers.read_records(spark, str(tmp_path)).collect()}
    assert set(got) == {"P11111", "P22222", "P55555", "P66666", "P44444"}
    assert (got["P11111"]["sequence"], got["P22222"]["sequence"], got["P44444"]["sequence"]) == ("AAA", "WXYZ", "CCC")
    first = text.split("//\n")[0] + "//\n"
    raw = (first.replace("P11111", "P77777") + "ID   OPEN\nAC   P88888\nSQ   S\n     AC\n").replace("\n", end).encode()
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "x.dat").write_bytes(raw)
    (r,) = readers.read_records(spark, str(tmp_path / "o")).collect()
    assert (r["uniprot_id"], r["sequence"], r["organism"]) == ("P77777", "ACDEFG", "Testus plantus.")
