"""Column functions on sequences: cleaning, composition, scales, tokens. All are built-in expressions (no UDF)."""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# Residue order and alphabet of the model's tokens (unknown 21, pad 0).
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
UNKNOWN, PAD = 21, 0
# Secondary-structure classes in one-hot order.
STRUCTURE_CLASSES = ("H", "G", "I", "E", "B", "T", "S", "-")
MAX_LENGTH = 1022

# Kyte and Doolittle (1982) hydropathy.
HYDROPATHY = {
    "A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5,
    "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2,
}
# Grantham (1974) polarity.
POLARITY = {
    "A": 8.1, "R": 10.5, "N": 11.6, "D": 13.0, "C": 5.5, "Q": 10.5, "E": 12.3, "G": 9.0, "H": 10.4, "I": 5.2,
    "L": 4.9, "K": 11.3, "M": 5.7, "F": 5.2, "P": 8.0, "S": 9.2, "T": 8.6, "W": 5.4, "Y": 6.2, "V": 5.9,
}
# Average residue masses in dalton (free amino acid less one water), and water.
MASS = {
    "A": 71.0788, "R": 156.1875, "N": 114.1038, "D": 115.0886, "C": 103.1388, "Q": 128.1307, "E": 129.1155, "G": 57.0519, "H": 137.1411, "I": 113.1594,
    "L": 113.1594, "K": 128.1741, "M": 131.1926, "F": 147.1766, "P": 97.1167, "S": 87.0782, "T": 101.1051, "W": 186.2132, "Y": 163.1760, "V": 99.1326,
}
WATER = 18.0153
# pK of side chains and chain ends (Bjellqvist 1993, default ends).
PK_POSITIVE = {"K": 10.0, "R": 12.0, "H": 5.98}
PK_NEGATIVE = {"D": 4.05, "E": 4.45, "C": 9.0, "Y": 10.0}
PK_N_TERM, PK_C_TERM = 7.5, 3.55


def clean(sequence: Column) -> Column:
    """All white space removed, upper-cased."""
    return F.upper(F.regexp_replace(sequence, r"\s+", ""))


def truncate(sequence: Column, most: int = MAX_LENGTH) -> tuple[Column, Column]:
    """The first `most` residues, and whether there were more."""
    return F.substring(sequence, 1, most), F.length(sequence) > most


def letters(sequence: Column) -> Column:
    return F.filter(F.split(sequence, ""), lambda c: c != "")


def scale_map(scale: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in scale.items() for x in pair])


def scale_values(sequence: Column, scale: dict[str, float], default: float | None = 0.0) -> Column:
    """array<double>: the scale's value of each residue; unknown residues get the default. A residue's value is one place of a literal array."""
    place, table = F.lit("".join(scale)), F.array(F.lit(default).cast("double"), *[F.lit(float(v)) for v in scale.values()])
    return F.transform(letters(sequence), lambda c: F.get(table, F.instr(place, c)))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def count_of(sequence: Column, residues: str) -> Column:
    """How many characters of the sequence are in residues."""
    rest = F.replace(sequence, F.lit(residues), F.lit("")) if len(residues) == 1 else F.translate(sequence, residues, "")
    return F.length(sequence) - F.length(rest)


def scale_total(sequence: Column, scale: dict[str, float]) -> Column:
    """The summed values of a sequence's residues, from how many there are of each; unknown ones count 0."""
    return functools.reduce(lambda a, b: a + b, [count_of(sequence, r) * F.lit(float(v)) for r, v in scale.items()])


def standard(sequence: Column) -> Column:
    """Only the twenty standard residues, and at least one."""
    return F.coalesce(sequence.rlike(f"\\A[{RESIDUES}]+\\z"), F.lit(False))


def aromaticity(sequence: Column) -> Column:
    return count_of(sequence, "FWY") / F.length(sequence)


def gravy(sequence: Column) -> Column:
    return scale_total(sequence, HYDROPATHY) / F.length(sequence)


def molecular_weight(sequence: Column) -> Column:
    return scale_total(sequence, MASS) + F.lit(WATER)


def dipeptide_index(sequence: Column, weights: dict[str, float], default: float = 1.0) -> Column:
    """10 / length times the summed weights of adjacent residue pairs; pairs without a weight count as default.

    Letters become numbers once; a pair's weight is then one place of a literal array, however many weights there are.
    """
    alphabet = "".join(sorted({c for pair in weights for c in pair}))
    wide = len(alphabet) + 1
    table = [default] * (wide * wide)
    for pair, w in weights.items():
        table[(alphabet.index(pair[0]) + 1) * wide + alphabet.index(pair[1]) + 1] = w
    values = F.from_json(F.lit(json.dumps(table)), "array<double>")
    numbers = F.transform(letters(sequence), lambda c: F.instr(F.lit(alphabet), c))

    def summed(x: Column) -> Column:
        pair = lambda s, p: F.struct((s["sum"] + F.get(x["values"], s["last"] * wide + p)).alias("sum"), p.alias("last"))
        first = F.struct(F.lit(0.0).alias("sum"), F.get(x["numbers"], F.lit(0)).alias("last"))
        return F.aggregate(F.slice(x["numbers"], F.lit(2), F.greatest(F.size(x["numbers"]) - 1, F.lit(0))), first, pair, lambda s: s["sum"])

    value = F.get(F.transform(F.array(F.struct(values.alias("values"), numbers.alias("numbers"))), summed), F.lit(0))
    return F.lit(10.0) / F.length(sequence) * F.when(F.length(sequence) > 1, value).otherwise(0.0)


def _charge(count, ph: Column) -> Column:
    """net_charge, of a function that gives the count of a residue."""
    up = lambda pk: F.lit(1.0) / (F.pow(F.lit(10.0), ph - F.lit(pk)) + 1.0)
    down = lambda pk: F.lit(1.0) / (F.pow(F.lit(10.0), F.lit(pk) - ph) + 1.0)
    charge = up(PK_N_TERM) - down(PK_C_TERM)
    for residue, pk in PK_POSITIVE.items():
        charge = charge + count(residue) * up(pk)
    for residue, pk in PK_NEGATIVE.items():
        charge = charge - count(residue) * down(pk)
    return charge


def net_charge(sequence: Column, ph: Column | float = 7.0) -> Column:
    """Charge by Henderson and Hasselbalch: closed form in residue counts."""
    return _charge(lambda r: count_of(sequence, r), F.lit(ph) if isinstance(ph, float) else ph)


def _point(counts: Column, steps: int = 40) -> Column:
    """isoelectric_point, of a struct of residue counts."""

    def charge(ph: Column, n: Column) -> Column:
        term = F.lit(1.0) / (F.pow(F.lit(10.0), ph - PK_N_TERM) + 1.0) - F.lit(1.0) / (F.pow(F.lit(10.0), F.lit(PK_C_TERM) - ph) + 1.0)
        for r, pk in PK_POSITIVE.items():
            term = term + n[r] / (F.pow(F.lit(10.0), ph - pk) + 1.0)
        for r, pk in PK_NEGATIVE.items():
            term = term - n[r] / (F.pow(F.lit(10.0), F.lit(pk) - ph) + 1.0)
        return term

    start = F.struct(F.lit(0.0).alias("low"), F.lit(14.0).alias("high"), counts.alias("n"))

    def halve(s: Column, _: Column) -> Column:
        middle = (s["low"] + s["high"]) / 2
        positive = charge(middle, s["n"]) > 0
        return F.struct(F.when(positive, middle).otherwise(s["low"]).alias("low"), F.when(positive, s["high"]).otherwise(middle).alias("high"), s["n"].alias("n"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: (s["low"] + s["high"]) / 2)


def isoelectric_point(sequence: Column, steps: int = 40) -> Column:
    """The pH in 0 to 14 of no net charge, by a fixed number of halvings."""
    return _point(F.struct(*[count_of(sequence, r).alias(r) for r in (*PK_POSITIVE, *PK_NEGATIVE)]), steps)


def finite(value: Column) -> Column:
    """value as a double, NULL unless it is a finite number (unparsable text too). The value is worked out once."""
    number = lambda x: F.when(F.abs(x) < float("inf"), x)  # noqa: E731 - NaN is greater than all numbers
    return F.get(F.transform(F.array(value.try_cast("double")), number), F.lit(0))


def imputed(value: Column, default: float = 0.0) -> Column:
    """finite(value), or the default: what features see, while statistics skip the missing."""
    return F.coalesce(finite(value), F.lit(default))


def properties(sequence: Column, weights: dict[str, float]) -> Column:
    """struct of the six properties; all 0.0 for sequences with other than standard residues, NULL where not finite. A row's residues are counted once."""
    known = standard(sequence)
    counts = [count_of(sequence, r).alias(r) for r in RESIDUES]
    pairs = F.when(known, dipeptide_index(sequence, weights))
    return properties_of(F.struct(*counts, F.length(sequence).alias("length"), pairs.alias("pairs"), known.alias("known")))


def properties_of(facts: Column) -> Column:
    """properties, of a struct of the residues' counts, the length, the pairs' index and whether all are standard."""

    def of(n: Column) -> Column:
        summed = lambda scale: functools.reduce(lambda a, b: a + b, [n[r] * F.lit(float(v)) for r, v in scale.items()])
        values = {
            "aromaticity": (n["F"] + n["W"] + n["Y"]) / n["length"],
            "charge_at_pH_7": _charge(lambda r: n[r], F.lit(7.0)),
            "gravy": summed(HYDROPATHY) / n["length"],
            "instability_index": n["pairs"],
            "isoelectric_point": _point(n),
            "molecular_weight": summed(MASS) + F.lit(WATER),
        }
        return F.struct(*[F.when(n["known"], finite(v)).otherwise(F.lit(0.0)).alias(k) for k, v in values.items()])

    return F.get(F.transform(F.array(facts), of), F.lit(0))


def residue_scales(volume: dict[str, float] | None = None) -> dict[str, dict[str, float]]:
    return {"hydrophobicity": HYDROPATHY, "polarity": POLARITY, "volume": volume or {"A": 0.0}}


def residue_features(sequence: Column, volume: dict[str, float] | None = None) -> Column:
    """array<struct<hydrophobicity, polarity, volume>>, one a residue; unknown residues are 0.0. The volume scale is an input. A residue's values are places of literal arrays."""
    scales = residue_scales(volume)
    alphabet = sorted({r for scale in scales.values() for r in scale if len(r) == 1})
    table = lambda scale: F.array(F.lit(0.0), *[F.lit(float(scale.get(r, 0.0))) for r in alphabet])
    place = F.transform(letters(sequence), lambda c: F.instr(F.lit("".join(alphabet)), c))
    return F.transform(place, lambda i: F.struct(*[F.get(table(scale), i).alias(k) for k, scale in scales.items()]))


def tokens(sequence: Column) -> Column:
    """array<int>: 1 to 20 by RESIDUES, 21 for anything else."""
    place = F.lit(RESIDUES)
    return F.transform(letters(sequence), lambda c: F.when(F.instr(place, c) > 0, F.instr(place, c)).otherwise(UNKNOWN))


def one_hot(value: Column, classes: tuple[str, ...] = STRUCTURE_CLASSES) -> Column:
    """array<int>, all 0 for NULL and unknown values."""
    return F.array(*[F.when(value.eqNullSafe(F.lit(c)), 1).otherwise(0) for c in classes])


def structure_percentages(classes: Column) -> Column:
    """struct<helix, sheet, coil> percentages of an array of classes: {H,G,I}, {E,B}, the rest; NULL without any residue."""
    n = F.size(classes)
    part = lambda names: F.size(F.filter(classes, lambda c: F.coalesce(c.isin(*names), F.lit(False))))
    helix, sheet = part(("H", "G", "I")), part(("E", "B"))
    share = lambda x: F.when(n > 0, x / n * 100.0)
    return F.struct(share(helix).alias("helix"), share(sheet).alias("sheet"), share(n - helix - sheet).alias("coil"))


def first_accession(ac: Column) -> Column:
    return F.trim(F.get(F.split(ac, ";"), F.lit(0)))


def taxonomy_id(ox: Column) -> Column:
    return F.nullif(F.regexp_extract(ox, r"NCBI_TaxID=(\d+)", 1), F.lit(""))


def query_id(name: Column) -> Column:
    """sp|ID|..., tr|ID|... give ID; all else itself."""
    parts = F.split(name, r"\|")
    return F.when((F.size(parts) >= 3) & F.get(parts, F.lit(0)).isin("sp", "tr"), F.get(parts, F.lit(1))).otherwise(name)


def number_text(value: Column) -> Column:
    """A double as SQL writes it: its shortest digits, with a point from 0.0001 up to below 1e16 and as 1e+16 beyond; the sign of -0.0 stays."""
    java = value.cast("double").cast("string")
    size = F.abs(value.cast("double"))
    sign = F.when(java.startswith("-"), "-").otherwise("")
    # 17 digits before the point and 21 behind it hold all digits of doubles in this range.
    digits = F.regexp_replace(F.ltrim(java, F.lit("-")).try_cast("decimal(38,21)").cast("string"), r"0+$", "")
    plain = F.concat(sign, digits, F.when(digits.endswith("."), "0").otherwise(""))
    power = F.substring_index(java, "E", -1).try_cast("int")
    two = F.lpad(F.abs(power).cast("string"), 2, "0")
    short = F.concat(F.regexp_replace(F.substring_index(java, "E", 1), r"\.0$", ""), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.when(F.abs(power) < 100, two).otherwise(F.abs(power).cast("string")))
    return F.when(F.isnan(value) | (size == float("inf")), F.replace(F.lower(java), F.lit("infinity"), F.lit("inf"))).when((size == 0) | (size >= 1e-4) & (size < 1e16), plain).otherwise(short)


def accession_root(accession: Column) -> Column:
    return F.substring_index(accession, ".", 1)


def prefix_key(identifier: Column) -> Column:
    """The partition key: the first character, ? for empty and NULL."""
    return F.coalesce(F.nullif(F.substring(identifier, 1, 1), F.lit("")), F.lit("?"))


def model_file_id(path: Column) -> Column:
    """The id in names of predicted-structure files, in any case; NULL for other names."""
    return F.nullif(F.regexp_extract(path, r"(?i)(?:^|/)AF-([A-Z0-9]+)-F\d+-model_v\d+\.pdb\.gz$", 1), F.lit(""))
