"""Normalisation statistics and fixed-width feature vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, NumericType, StructField, StructType

from seqloom.functions import sequences as S
from seqloom.operators import moments as moments_of
from seqloom.operators.integrate import LABEL_DOMAINS, has_domain
from seqloom.storage import free_name, is_small, saved, ship

STD_FLOOR = 1e-7
PROPERTIES = ("molecular_weight", "aromaticity", "instability_index", "isoelectric_point", "gravy", "charge_at_pH_7")
PERCENTAGES = ("helix_percentage", "sheet_percentage", "coil_percentage")
RESIDUE = ("hydrophobicity", "polarity", "volume", "relative_accessibility", "phi", "psi")


def protein_values(missing: float | None = None) -> list[Column]:
    """The 13 protein features in their fixed order. missing: NULL for statistics, 0.0 for features."""
    first = F.get(F.col("structural_features"), F.lit(0))
    raw = [F.col("sequence_length"), *[F.col("physicochemical_properties")[p] for p in PROPERTIES], *[first[p] for p in PERCENTAGES]]
    values = [S.finite(c) if missing is None else S.imputed(c, missing) for c in raw]
    return values + [has_domain(F.col("domains"), d).cast("double") for d in LABEL_DOMAINS]


def moments(values: list[Column]) -> tuple[Column, Column]:
    """Aggregates: arrays of means and population deviations, missing values skipped; no value gives 0, deviations are at least STD_FLOOR."""
    mean = F.array(*[F.coalesce(F.avg(v), F.lit(0.0)) for v in values])
    std = F.array(*[F.greatest(F.coalesce(F.stddev_pop(v), F.lit(0.0)), F.lit(STD_FLOOR)) for v in values])
    return mean, std


def protein_stats(df: DataFrame) -> DataFrame:
    mean, std = moments(protein_values())
    return df.agg(mean.alias("protein_mean"), std.alias("protein_std"))


def _by_letter(df: DataFrame) -> bool:
    """Whether df is integrate.joined's table: the first three residue values are those of the letters, by the scales."""
    return "residue_features" not in df.columns


def _scale_tables(volume: dict[str, float] | None = None) -> dict[str, np.ndarray]:
    """Each scale's values by code point; the last one, 0, is for all beyond."""
    scales = S.residue_scales(volume)
    most = max(ord(r) for scale in scales.values() for r in (*scale, S.RESIDUES[-1]) if len(r) == 1)
    return {name: np.array([float(scale.get(chr(i), 0.0)) for i in range(max(most, 127) + 2)]) for name, scale in scales.items()}


def _residue_lists(df: DataFrame) -> list[Column]:
    """The six lists of residue values of a row (three where the letters say the others), as doubles; texts that aren't numbers are NULL."""
    first = F.get(F.col("structural_features"), F.lit(0))
    lists = [] if _by_letter(df) else [F.col("residue_features")[c] for c in RESIDUE[:3]]
    lists += [first["dssp_residue_details"][c] for c in RESIDUE[3:]]
    kinds = df.select(*[c.alias(str(i)) for i, c in enumerate(lists)]).schema
    number = lambda f: isinstance(f.dataType.elementType, NumericType)
    return [c.cast("array<double>") if number(f) else F.transform(c, S.finite) for c, f in zip(lists, kinds, strict=True)]


def residue_states(df: DataFrame, volume: dict[str, float] | None = None) -> DataFrame:
    """Batches of df's rows as a state (moments.list_states) of each residue value, over the positions below sequence_length; missing values are skipped."""
    n = F.greatest(F.coalesce(F.col("sequence_length"), F.lit(0)).cast("int"), F.lit(0))
    lists = _residue_lists(df)
    cut = [F.slice(c, F.lit(1), n).alias(name) for name, c in zip(RESIDUE[-len(lists) :], lists, strict=True)]
    if not _by_letter(df):
        return moments_of.list_states(df.select(*cut))
    seq = F.col("sequence")
    return moments_of.list_states(df.select(F.when(F.length(seq) <= n, seq).otherwise(F.substring(seq, F.lit(1), n)).alias("letters"), *cut), _scale_tables(volume))


def residue_stats(df: DataFrame, volume: dict[str, float] | None = None) -> DataFrame:
    """One row of residue_mean and residue_std. Batches of rows are folded to states and these merged: no row a residue is made."""
    one = moments_of.merge_rows(residue_states(df, volume), list(RESIDUE))
    mean = F.array(*[moments_of.mean_of(F.col(c), 0.0) for c in RESIDUE])
    std = F.array(*[F.greatest(moments_of.deviation_of(F.col(c), 0.0), F.lit(STD_FLOOR)) for c in RESIDUE])
    return one.select(mean.alias("residue_mean"), std.alias("residue_std"))


def stats(df: DataFrame, volume: dict[str, float] | None = None) -> DataFrame:
    """The one row of four arrays. Only the columns that it needs are read, nested fields included. volume: the scale for a table without residue features."""
    return protein_stats(df).crossJoin(F.broadcast(residue_stats(df, volume)))  # one row each


def without_residues(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(F.coalesce(F.size("residue_features"), F.lit(0)) <= 0).alias("without_residue_features"))


def zscore(values: Column, mean: Column, std: Column) -> Column:
    return F.zip_with(F.zip_with(values, mean, lambda x, m: x - m), std, lambda x, s: x / s)


def repaired(rows: Column, n: Column, pad: Column) -> Column:
    """A list cut or padded to n elements."""
    return F.concat(F.slice(rows, F.lit(1), n), F.array_repeat(pad, F.greatest(n - F.size(rows), F.lit(0))))


#: Positions whose features are made at a time, or one row's.
POSITIONS = 1 << 19
#: Token by code point; all from 128 on are unknown.
TOKENS = np.array([S.RESIDUES.find(chr(i)) + 1 or S.UNKNOWN for i in range(129)], dtype=np.int32)


def _laid(values: np.ndarray, sizes: np.ndarray, n: np.ndarray, missing: float) -> np.ndarray:
    """Lists of the given sizes, one after another, cut or filled with `missing` to n elements each."""
    if np.array_equal(sizes, n):
        return values
    k = np.minimum(sizes, n)
    row, within = np.repeat(np.arange(len(k)), k), np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
    out = np.full(n.sum(), missing, dtype=values.dtype)
    out[(np.cumsum(n) - n)[row] + within] = values[(np.cumsum(sizes) - sizes)[row] + within]
    return out


def _sizes(column: pa.ListArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)


def _rows_of(b: pa.RecordBatch, codes: np.ndarray, n: np.ndarray, scales: dict[str, np.ndarray]) -> np.ndarray:
    """The values of the first n residues of each row, whose letters have these codes: 14 a residue."""
    mean, std = (moments_of.numbers_of(b.column(c).slice(0, 1)) for c in ("residue_mean", "residue_std"))
    out = np.zeros((n.sum(), len(RESIDUE) + len(S.STRUCTURE_CLASSES)), dtype=np.float32)
    with np.errstate(over="ignore"):
        for i, c in enumerate(RESIDUE):
            if c in scales:
                values = np.where(np.isfinite(scales[c]), scales[c], 0.0)
                out[:, i] = ((values - mean[i]) / std[i]).astype(np.float32)[np.minimum(codes, len(values) - 1)]
                continue
            x = _laid(moments_of.numbers_of(b.column(c)), _sizes(b.column(c)), n, 0.0)
            out[:, i] = (np.where(np.isfinite(x), x, 0.0) - mean[i]) / std[i]
    kinds = b.column("kinds")
    kind = pc.fill_null(pc.index_in(kinds.flatten(), value_set=pa.array(S.STRUCTURE_CLASSES)), -1).to_numpy(zero_copy_only=False)
    kind = _laid(kind, _sizes(kinds), n, S.STRUCTURE_CLASSES.index("-"))
    known = np.flatnonzero(kind >= 0)
    out[known, len(RESIDUE) + kind[known]] = 1.0
    return out


def _featurised_part(b: pa.RecordBatch, n: np.ndarray, names: list[str], scales: dict[str, np.ndarray]) -> pa.RecordBatch:
    """The features of some rows of n residues each."""
    codes = moments_of.text_codes(b.column("letters"))
    out = _rows_of(b, codes, n, scales)
    ends = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
    rows = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))
    tokens = pa.ListArray.from_arrays(ends, pa.array(TOKENS[np.minimum(codes, 128)]))
    return pa.RecordBatch.from_arrays([b.column("uniprot_id"), tokens, pa.ListArray.from_arrays(ends, rows), b.column("protein_features"), b.column("gelation")], names)


def kinds_of_residues(b: pa.RecordBatch, n: np.ndarray, scales: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of n residues each: the kind of each residue, and of each kind its token and its 14 values.

    Residues that no list has a value for are of their letter's kind; every other one is a kind by itself.
    """
    codes = moments_of.text_codes(b.column("letters"))
    most = len(next(iter(scales.values()))) if scales else 129  # code points of kinds; the last one is for all beyond
    letters = np.arange(most)
    empty = pa.RecordBatch.from_arrays([pa.array([[]], c.type) if name in (*RESIDUE, "kinds") else c.slice(0, 1) for name, c in zip(b.schema.names, b.columns, strict=True)], b.schema.names)
    plain = _rows_of(empty, letters, np.array([most]), scales)
    place = np.minimum(codes, most - 1).astype(np.intp)
    listed = np.minimum(n, np.max([_sizes(b.column(c)) for c in (*RESIDUE, "kinds") if c not in scales], axis=0))
    own = np.repeat(np.cumsum(n) - n, listed) + np.arange(listed.sum()) - np.repeat(np.cumsum(listed) - listed, listed)
    values = _rows_of(b, codes[own], listed, scales)
    tokens = TOKENS[np.minimum(np.concatenate((letters, codes[own])), 128)]
    place[own] = most + np.arange(len(own))
    return place, tokens, np.concatenate((plain, values))


def flat(df: DataFrame, stats_row: DataFrame, keep_empty: bool = False) -> DataFrame:
    """df with what the features of its residues are made from, a row a sequence."""
    seq = F.coalesce(F.col("sequence"), F.lit(""))
    n = F.length(seq)
    joined = (df if keep_empty else df.where(n > 0)).crossJoin(F.broadcast(stats_row))  # one row
    details = F.get(F.col("structural_features"), F.lit(0))["dssp_residue_details"]
    kinds = F.transform(details, lambda d: F.when(d.isNull(), F.lit("-")).otherwise(d["secondary_structure"]))
    protein = zscore(F.array(*protein_values(0.0)), F.col("protein_mean"), F.col("protein_std")).cast("array<float>")
    lists = _residue_lists(df)
    return joined.select(
        "uniprot_id", seq.alias("letters"), *[c.alias(name) for name, c in zip(RESIDUE[-len(lists) :], lists, strict=True)], kinds.cast("array<string>").alias("kinds"), "residue_mean", "residue_std",
        F.when(n > 0, protein).otherwise(F.array_repeat(F.lit(0.0).cast("float"), 13)).alias("protein_features"),
        F.when((F.col("gelation") == "yes") & (n > 0), 1.0).otherwise(0.0).cast("float").alias("gelation"),
    )


def parts(batches):
    """Batches of flat's rows in parts of at most POSITIONS residues, or one row, with each row's residues."""
    for b in batches:
        sizes = pc.utf8_length(b.column("letters")).to_numpy().astype(np.int64)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if i > start and held + size > POSITIONS:
                yield b.slice(start, i - start), sizes[start:i]
                start, held = i, 0
            held += size
        if len(sizes):
            yield b.slice(start), sizes[start:]


def scales_of(df: DataFrame, volume: dict[str, float] | None = None) -> dict[str, np.ndarray]:
    """The residue values that df's letters say, by code point; none if it has residue features."""
    return _scale_tables(volume) if _by_letter(df) else {}


def featurised(df: DataFrame, stats_row: DataFrame, keep_empty: bool = False, volume: dict[str, float] | None = None) -> DataFrame:
    """(uniprot_id, sequence array<int>, residue_features L x 14, protein_features 13, gelation 0/1).

    Missing values are 0.0 before they are normalised. Rows without a sequence are left out, or (keep_empty)
    have empty lists, zero vectors and label 0. Values of residues are put side by side in numpy, some rows at a time.
    volume: the scale for a table without residue features (integrate.joined).
    """
    ship(df.sparkSession)
    scales = scales_of(df, volume)
    floats = ArrayType(FloatType())
    schema = StructType([df.schema["uniprot_id"], StructField("sequence", ArrayType(IntegerType())), StructField("residue_features", ArrayType(floats)), StructField("protein_features", floats), StructField("gelation", FloatType())])

    def scan(batches):
        for b, sizes in parts(batches):
            yield _featurised_part(b, sizes, schema.names, scales)

    return flat(df, stats_row, keep_empty).mapInArrow(scan, schema)


def batches(df: DataFrame, index: str, size: int, length: str | Column = "sequence") -> DataFrame:
    """df with batch (index div size) and batch_length, the greatest length in the batch: of the list column named by length, or a column that says it.

    Only lengths are aggregated, a row a batch; these are broadcast if they are few by a count.
    """
    if size < 1:
        raise ValueError("a batch has at least one row")
    batch = F.floor(F.col(index) / size).cast("long")
    n = F.size(length) if isinstance(length, str) else length
    longest = saved(df.groupBy(batch.alias("batch")).agg(F.max(n).alias("batch_length")), "lengths")
    return df.withColumn("batch", batch).join(F.broadcast(longest) if is_small(longest) else longest, "batch")


def collated(df: DataFrame, least: int = 7) -> DataFrame:
    """Batched rows padded to their batch's length, at least the widest kernel; rows of NULL sequences are left out."""
    n = F.greatest(F.col("batch_length"), F.lit(least))
    zeros = F.array_repeat(F.lit(0.0).cast("float"), 14)
    kept = df.where("sequence IS NOT NULL")
    return kept.withColumn("residue_features", repaired(F.col("residue_features"), n, zeros)).withColumn("sequence", repaired(F.col("sequence"), n, F.lit(S.PAD)))


#: Rows that one task puts in order, about, when rows are shuffled.
DEALT = 1_000_000


def shuffled(df: DataFrame, key: str, seed: int, epoch: int = 0, dealt: int = DEALT) -> DataFrame:
    """df with place, from 0: a random order, the same for the same seed, epoch and rows, however they are partitioned.

    Rows are dealt to buckets by the first bits of a hash of seed, epoch and key, and ordered by it within their bucket; a bucket's rows come behind
    those of the buckets before. Nothing is sampled, and no task has much more than `dealt` rows. Rows of one key stand together.
    """
    h, bucket, place = (free_name(df, n) for n in ("__h", "__bucket", "place"))
    bits = max(0, (max(1, df.count()) - 1).bit_length() - (dealt.bit_length() - 1))
    mixed = F.xxhash64(F.lit(seed), F.lit(epoch), F.col(key))
    # The hash as a number that rises from the least long on; its first bits are the bucket.
    out = df.withColumn(h, mixed).withColumn(bucket, F.shiftright(F.col(h), 64 - bits) if bits else F.lit(0).cast("long"))
    sizes = out.groupBy(bucket).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a bucket
    n = free_name(df, "__n")
    out = out.join(F.broadcast(sizes.select(bucket, before.alias(n))), bucket)
    within = F.row_number().over(Window.partitionBy(bucket).orderBy(h, key)) - 1
    return out.withColumn(place, F.col(n) + within).drop(h, bucket, n)
