"""The integrated schema, defined once, and helpers that walk schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, LongType, StringType, StructField, StructType

_TYPES = {"s": StringType(), "l": LongType(), "d": DoubleType()}


def _struct(**fields: str | DataType) -> StructType:
    """Nullable fields; s, l and d stand for string, long and double."""
    return StructType([StructField(k, _TYPES[v] if isinstance(v, str) else v) for k, v in fields.items()])


DBREF = _struct(chain="s", accession="s", db_id_code="s", pdb_start_res="l", pdb_end_res="l", db_start_res="l", db_end_res="l")
RESIDUE = _struct(chain="s", residue_seq="l", residue_icode="s", amino_acid="s", secondary_structure="s", relative_accessibility="d", phi="d", psi="d")
ALPHA_CARBON = _struct(index="l", chain="s", residue_seq="l", residue_icode="s", x="d", y="d", z="d")
STRUCTURE = _struct(
    pdb_id="s", pdb_file="s", dbref_records=ArrayType(DBREF), helix_percentage="d", sheet_percentage="d", coil_percentage="d", total_residues_dssp="l",
    dssp_residue_details=ArrayType(RESIDUE), ca_coordinates=ArrayType(ALPHA_CARBON), contact_map_indices_ca=ArrayType(_struct(idx1="l", idx2="l")), processing_error="s",
)
DOMAIN = _struct(accession="s", bias="d", description="s", end="l", envelope_end="l", envelope_start="l", evalue="d", hmm_end="l", hmm_start="l", score="d", start="l", target_name="s")
PROPERTIES = _struct(aromaticity="d", charge_at_pH_7="d", gravy="d", instability_index="d", isoelectric_point="d", molecular_weight="d")
RESIDUE_FEATURES = ArrayType(_struct(hydrophobicity="d", polarity="d", volume="d"))

INTEGRATED = _struct(
    uniprot_id="s", sequence="s", sequence_length="l", organism="s", taxonomy_id="s", physicochemical_properties=PROPERTIES, residue_features=RESIDUE_FEATURES,
    structural_features=ArrayType(STRUCTURE), domains=ArrayType(DOMAIN), gelation="s", uniprot_id_prefix="s",
)


def without_nan(column: Column, kind: DataType) -> Column:
    """column with NaN and infinities as NULL, at any depth of structs and arrays."""
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(F.isnan(column) | (F.abs(column) == float("inf")), None).otherwise(column)
    if isinstance(kind, ArrayType):
        return F.transform(column, lambda x: without_nan(x, kind.elementType))
    if isinstance(kind, StructType):
        return F.when(column.isNotNull(), F.struct(*[without_nan(column[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return column


def clean(df: DataFrame) -> DataFrame:
    return df.select(*[without_nan(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def aligned(df: DataFrame, schema: StructType = INTEGRATED) -> DataFrame:
    """df with exactly the columns of schema, in its order: missing ones NULL, surplus ones dropped."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
