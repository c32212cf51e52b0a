"""Sinks: partitioned and plain Parquet, JSON, FASTA, TSV, statistics and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seqloom import schemas
from seqloom.functions import sequences as S
from seqloom.storage import free_name


#: Rows of a prefix that one task writes, about.
ROWS_PER_TASK = 1_000_000


def write_partitioned(df: DataFrame, path: str, schema: StructType = schemas.INTEGRATED, mode: str = "overwrite", key: str = "uniprot_id", rows_per_task: int = ROWS_PER_TASK) -> None:
    """Parquet partitioned by the first character of the id (<key>_prefix). A prefix of many rows is dealt to as many tasks as its rows need, by a hash of the id."""
    prefix = f"{key}_prefix"
    tasks, spread = free_name(df, "__tasks"), free_name(df, "__spread")
    out = schemas.aligned(schemas.clean(df).withColumn(prefix, S.prefix_key(F.col(key))), schema)
    sizes = df.groupBy(S.prefix_key(F.col(key)).alias(prefix)).agg(F.ceil(F.count("*") / rows_per_task).alias(tasks))
    out = out.join(F.broadcast(sizes), prefix).withColumn(spread, F.pmod(F.xxhash64(key), F.col(tasks)))
    out.repartition(prefix, spread).drop(spread, tasks).select(*schema.names).write.mode(mode).partitionBy(prefix).parquet(path)


def subset(df: DataFrame, ids: DataFrame, key: str = "uniprot_id") -> DataFrame:
    """Rows of df whose key, as a string, is in ids."""
    wanted = ids.select(F.col(key).cast("string").alias("__key")).distinct()
    return df.join(wanted, F.col(key).cast("string") == F.col("__key"), "left_semi")


def write_subset(df: DataFrame, ids: DataFrame, path: str, schema: StructType = schemas.INTEGRATED, mode: str = "overwrite") -> bool:
    """Unpartitioned Parquet of the subset; nothing is written, and False returned, if it is empty."""
    chosen = schemas.aligned(subset(df, ids), schema)
    if chosen.isEmpty():
        return False
    chosen.write.mode(mode).parquet(path)
    return True


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_fasta(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Two lines a row: a header with the id, and the sequence."""
    df.select(fasta_entry()).write.mode(mode).text(path)


def fasta_entry(identifier: str = "uniprot_id", sequence: str = "sequence"):
    return F.concat(F.lit(">sp|"), F.col(identifier), F.lit("|Generated\n"), F.col(sequence)).alias("value")


def write_embeddings(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """(uniprot_id, embedding array<float>) as Parquet."""
    df.select("uniprot_id", F.col("embedding").cast("array<float>")).write.mode(mode).parquet(path)


def write_stats(stats: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The one row of statistics as a JSON object."""
    stats.select(F.to_json(F.struct(*stats.columns)).alias("value")).coalesce(1).write.mode(mode).text(path)


def prediction_lines(df: DataFrame, identifier: str = "uniprot_id", probability: str = "probability") -> DataFrame:
    """(ID, Gelation_Probability) with six decimals, as text."""
    return df.select(F.col(identifier).cast("string").alias("ID"), F.format_string("%.6f", F.col(probability)).alias("Gelation_Probability"))


def write_predictions(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    prediction_lines(df).write.mode(mode).option("sep", "\t").option("header", True).csv(path)


def write_report(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The one row of metrics as lines `name: value`."""
    pairs = F.explode(F.array(*[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("n/a"))) for c in metrics.columns]))
    metrics.select(pairs.alias("value")).coalesce(1).write.mode(mode).text(path)
