"""Integration of one-to-many annotations and the rule label."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from seqloom.functions import sequences as S
from seqloom.operators.moments import text_bytes
from seqloom.storage import free_name, is_small, ship

# The domains and thresholds of the label rule.
LABEL_DOMAINS = ("PF00190", "PF04702", "PF00234")
SHEET_PERCENT, GRAVY, INSTABILITY = 30.0, 0.0, 40.0


def as_lists(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """(key, name): the other columns of each key's rows as a list of structs, ordered by `order` and then all values."""
    rest = [c for c in rows.columns if c != key]
    packed = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*rest).alias("r"))))
    return rows.groupBy(key).agg(F.transform(packed, lambda x: x["r"]).alias(name))


def left_lists(left: DataFrame, lists: DataFrame, key: str, name: str) -> DataFrame:
    """left with the list column name; rows without a match get an empty list."""
    kind = lists.schema[name].dataType
    return left.join(lists, key, "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(kind)))


def fan_out(rows: DataFrame, ids: str, key: str) -> DataFrame:
    """One row a distinct id of the list column ids."""
    return rows.withColumn(key, F.explode(F.array_distinct(ids))).drop(ids)


def has_domain(domains: Column, accession: str) -> Column:
    return F.coalesce(F.exists(domains, lambda d: d["accession"] == accession), F.lit(False))


def label(domains: Column, structures: Column, gravy: Column, instability: Column) -> Column:
    """yes if a listed domain, a sheet share above 30, or both gravy above 0 and instability above 40; NULL never counts."""
    by_domain = F.coalesce(F.exists(domains, lambda d: F.coalesce(d["accession"].isin(*LABEL_DOMAINS), F.lit(False))), F.lit(False))
    by_sheet = F.coalesce(F.exists(structures, lambda s: F.coalesce(s["sheet_percentage"] > SHEET_PERCENT, F.lit(False))), F.lit(False))
    by_values = F.coalesce((gravy > GRAVY) & (instability > INSTABILITY), F.lit(False))
    return F.when(by_domain | by_sheet | by_values, "yes").otherwise("no")


def counted(proteins: DataFrame, weights: dict[str, float], name: str = "facts") -> DataFrame:
    """proteins with what S.properties_of takes of their sequences, in numpy, a batch of rows at a time; counts are those of standard sequences."""
    ship(proteins.sparkSession)
    n = len(S.RESIDUES)
    place = np.full(256, n, dtype=np.uint8)
    place[[ord(r) for r in S.RESIDUES]] = np.arange(n)
    table = np.ones(n * n)
    for (a, b), w in ((pair, w) for pair, w in weights.items() if set(pair) <= set(S.RESIDUES)):
        table[S.RESIDUES.index(a) * n + S.RESIDUES.index(b)] = w
    whole, number, yes = IntegerType(), DoubleType(), BooleanType()
    fields = [*[StructField(r, whole) for r in S.RESIDUES], StructField("length", whole), StructField("pairs", number), StructField("known", yes)]
    schema = StructType([*proteins.schema.fields, StructField(name, StructType(fields))])
    names = schema.names

    def scan(batches):
        for b in batches:
            data, ends = text_bytes(b.column("sequence"))
            data, counts = place[data], np.zeros((b.num_rows, n + 1), dtype=np.int32)
            pairs = np.zeros(b.num_rows)
            for i, (start, end) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                row = data[start:end]
                counts[i] = np.bincount(row, minlength=n + 1)
                if end - start > 1 and not counts[i, n]:
                    at = row[:-1].astype(np.intp) * n
                    at += row[1:]
                    # One after another, as the expression adds them.
                    pairs[i] = 10.0 / (end - start) * np.add.accumulate(table[at])[-1]
            length = counts.sum(axis=1, dtype=np.int32)
            known = (length > 0) & (counts[:, n] == 0)
            columns = [*[pa.array(counts[:, i]) for i in range(n)], pa.array(length), pa.array(pairs, mask=~known), pa.array(known)]
            facts = pa.StructArray.from_arrays(columns, [*S.RESIDUES, "length", "pairs", "known"])
            yield pa.RecordBatch.from_arrays([*b.columns, facts], names)

    return proteins.mapInArrow(scan, schema)


def joined(proteins: DataFrame, domains: DataFrame, structures: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The integrated table without its residue features. Lists are made only of rows that have a protein."""
    ids = proteins.select("uniprot_id").distinct()
    ids = F.broadcast(ids) if is_small(ids) else ids
    domains, structures = (df.join(ids, "uniprot_id", "left_semi") for df in (domains, structures))
    hits = as_lists(domains, "uniprot_id", ["start"], "domains").withColumn("domains", F.expr("CAST(domains AS array<struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in domains.schema if f.name != "uniprot_id") + ">>)"))
    shapes = as_lists(structures, "uniprot_id", ["pdb_id"], "structural_features")
    # Lists are joined first: a row a residue of values doesn't go through a shuffle.
    facts = free_name(proteins, "facts")
    out = left_lists(left_lists(counted(proteins, weights, facts), hits, "uniprot_id", "domains"), shapes, "uniprot_id", "structural_features")
    out = out.withColumn("physicochemical_properties", S.properties_of(F.col(facts))).drop(facts)
    p = F.col("physicochemical_properties")
    out = out.withColumn("gelation", label(F.col("domains"), F.col("structural_features"), p["gravy"], p["instability_index"]))
    return out.withColumn("uniprot_id_prefix", S.prefix_key(F.col("uniprot_id")))


def integrate(proteins: DataFrame, domains: DataFrame, structures: DataFrame, weights: dict[str, float], volume: dict[str, float] | None = None) -> DataFrame:
    """The integrated table: proteins (read_records) with properties, residue features, lists and label.

    domains: a row a hit, with uniprot_id; structures: a row a (uniprot_id, structure). Lists are ordered, so
    that "the first structure" means the one of the smallest pdb_id.
    """
    return with_residues(joined(proteins, domains, structures, weights), volume)


def with_residues(table: DataFrame, volume: dict[str, float] | None = None) -> DataFrame:
    """joined's table with the residue features, in the columns' usual order."""
    out = table.withColumn("residue_features", S.residue_features(F.col("sequence"), volume))
    return out.select(*table.columns[:-2], "residue_features", *table.columns[-2:])


def summary(integrated: DataFrame) -> DataFrame:
    """One row: rows, rows without a structure, rows labelled yes."""
    return integrated.agg(
        F.count("*").alias("total"),
        F.count_if(F.size("structural_features") == 0).alias("without_structure"),
        F.count_if(F.col("gelation") == "yes").alias("labelled_yes"),
    )


def from_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as proteins: whole cleaned texts as sequences."""
    return docs.select(F.col(id_col).cast("string").alias("uniprot_id"), S.clean(F.col(text_col)).alias("sequence")).where("sequence <> ''")

