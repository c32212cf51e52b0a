"""Structure records: one pass over structure files, whose lines of all kinds become a row a file, put together with residues and contacts."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from seqloom import schemas
from seqloom.functions import sequences as S
from seqloom.operators.integrate import as_lists, fan_out
from seqloom.operators.spatial import CONTACT_RADIUS, range_pairs
from seqloom.sources import readers
from seqloom.storage import saved, ship

NO_RESIDUES = "no residue rows for this structure"
#: Names of structure files, in any case; those of compressed ones end with .gz.
SUFFIXES = r"(?i)\.pdb(\.gz)?$"

_PARSED = StructType([
    StructField("file", StringType()), StructField("dbref_records", ArrayType(schemas.DBREF)), StructField("ca_coordinates", ArrayType(schemas.ALPHA_CARBON)), StructField("error", StringType()),
])


def parse(content: bytes, packed: bool) -> tuple[list[dict], list[dict], str | None]:
    """Cross references, alpha carbons of the first model, and what was wrong (None: nothing) of one structure file.

    Malformed cross references are left out, as they always were. A broken atom line, or compressed content that
    breaks off, is an error: there are no atoms then, but the references that could be read stay.
    """
    references, atoms, error = [], [], None
    if packed:
        inflate, raw = zlib.decompressobj(wbits=31), b""
        try:
            while content:  # members one behind the other
                raw += inflate.decompress(content) + inflate.flush()
                if not inflate.eof:
                    raise EOFError("the compressed content breaks off")
                content = inflate.unused_data
                inflate = zlib.decompressobj(wbits=31)
        except (zlib.error, EOFError) as e:
            error = f"unreadable file: {e}"
        content = raw
    model = True
    for number, line in enumerate(content.decode("utf-8", "ignore").splitlines(), 1):
        kind = line[:6]
        if kind == "DBREF " and len(line) > 41 and line[26:32].strip() == "UNP":
            try:
                places = {k: int(line[a:b]) for k, (a, b) in {"pdb_start_res": (14, 18), "pdb_end_res": (20, 24), "db_start_res": (55, 60), "db_end_res": (62, 67)}.items()}
            except ValueError:
                continue
            references.append({"chain": line[12:13].strip(), "accession": line[33:41].strip(), "db_id_code": line[42:54].strip(), **places})
        elif kind == "ENDMDL":
            model = False
        elif model and kind in ("ATOM  ", "HETATM") and line[12:16].strip() == "CA":
            try:
                x, y, z = (float(line[i : i + 8]) for i in (30, 38, 46))
                atoms.append({"index": len(atoms), "chain": line[21:22].strip(), "residue_seq": int(line[22:26]), "residue_icode": line[26:27].strip(), "x": x, "y": y, "z": z})
            except ValueError:
                error = error or f"unreadable atom in line {number}"
    return references, atoms if len(atoms) > 1 and not error else [], error


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, dbref_records, ca_coordinates, error): a row a structure file below path, in folders at any depth. A bad file is a row with an error, and stops nothing."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("path").rlike(SUFFIXES))
    types = [to_arrow_type(f.dataType) for f in _PARSED]

    def scan(batches):
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                row = (name, *parse(content.as_py() or b"", name.lower().endswith(".gz")))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], _PARSED.names)

    return files.select("path", "content").mapInArrow(scan, _PARSED)


def assemble(files: DataFrame, residues: DataFrame, radius: float = CONTACT_RADIUS) -> DataFrame:
    """(uniprot_id, and the fields of schemas.STRUCTURE): a row an accession that a structure file names.

    files: as read_files gives them; residues have pdb_id. A file's pdb_id is its name without the suffix. Files without
    a cross reference give no rows. Structures without residue rows have NULL percentages, no residues and 0 in total; that, and what was wrong with the file, is said in
    processing_error. Those without alpha carbons have empty lists. Every list is in a fixed order.
    """
    name = F.substring_index("file", "/", -1)
    order = F.array_sort(F.transform("dbref_records", lambda r: F.struct(r["chain"].alias("c"), r["db_start_res"].alias("s"), r.alias("r"))))
    files = files.select("file", name.alias("pdb_file"), F.regexp_replace(name, r"(?i)\.pdb(\.gz)?$|\.[^.]*$", "").alias("pdb_id"), F.transform(order, lambda x: x["r"]).alias("dbref_records"), "ca_coordinates", "error")
    details = as_lists(residues.select("pdb_id", *schemas.RESIDUE.fieldNames()), "pdb_id", ["chain", "residue_seq", "residue_icode"], "dssp_residue_details")
    atoms = files.select("file", F.inline("ca_coordinates"))
    contacts = as_lists(range_pairs(atoms, radius, "file"), "file", ["idx1", "idx2"], "contact_map_indices_ca")
    out = files.where(F.size("dbref_records") > 0).join(details, "pdb_id", "left").join(contacts, "file", "left")
    share = S.structure_percentages(F.col("dssp_residue_details")["secondary_structure"])
    known = F.col("dssp_residue_details").isNotNull()
    said = F.concat_ws("; ", "error", F.when(~known, NO_RESIDUES))
    out = out.select(
        F.filter(F.transform("dbref_records", lambda r: r["accession"]), lambda a: a != "").alias("ids"), "pdb_id", "pdb_file", "dbref_records",
        *[F.when(known, share[k]).alias(f"{k}_percentage") for k in ("helix", "sheet", "coil")],
        F.when(known, F.size("dssp_residue_details")).otherwise(0).cast("long").alias("total_residues_dssp"),
        *[F.coalesce(F.col(c), F.array().cast(schemas.STRUCTURE[c].dataType)).alias(c) for c in ("dssp_residue_details", "ca_coordinates", "contact_map_indices_ca")],
        F.nullif(said, F.lit("")).alias("processing_error"),
    )
    return fan_out(out, "ids", "uniprot_id").select("uniprot_id", *schemas.STRUCTURE.fieldNames())


def read_structures(spark: SparkSession, path: str, residues: str, radius: float = CONTACT_RADIUS) -> DataFrame:
    """assemble() of the structure files below path, read once, and the residue rows (JSON lines) at residues."""
    return assemble(saved(read_files(spark, path), "structures"), readers.read_residues(spark, residues), radius)
