"""Readers: flat records, domain tables, structure files, FASTA, keyed JSON, Parquet. All give DataFrames."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from seqloom import schemas
from seqloom.functions import sequences as S
from seqloom.storage import free_name, is_small, saved

_PDB = StructType([StructField("pdb_id", StringType())])


def tagged_fields(record: Column, tags: tuple[str, ...] = ("AC", "OS", "OX")) -> dict[str, Column]:
    """Columns of a record's text: one a tag (its lines' contents joined by a space), and SQ (the sequence).

    Lines with a tag are two letters and three spaces; lines of five spaces continue the tag before. After the
    SQ line come sequence lines, of which white space and digits are removed.
    """
    # Continuation lines join the line they continue, so that each entry of a tag is one line.
    head = F.regexp_replace(F.regexp_extract(record, r"(?s)\A(.*?)(?:(?:\A|\n)SQ   |\z)", 1), r"\n {5}\s*", " ")
    entries = F.split(head, "\n")

    def joined(tag: str) -> Column:
        own = F.filter(entries, lambda line: line.startswith(f"{tag}   "))
        return F.when(F.size(own) > 0, F.array_join(F.transform(own, lambda line: F.trim(F.substring(line, 6, 1 << 30))), " "))

    out = {tag: joined(tag) for tag in tags}
    after = F.regexp_extract(record, r"(?s)(?:\A|\n)SQ   [^\n]*\n(.*)\z", 1)
    kept = F.filter(F.split(after, "\n"), lambda line: line.startswith("     "))
    out["SQ"] = F.regexp_replace(F.array_join(kept, ""), r"[\s\d]", "")
    return out


#: Names of files that are inflated while they are read.
COMPRESSED = r"\.(gz|bz2|deflate|zst|lz4|snappy)$"


def _terminated(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, value): the texts of flat files that a line // ends, with \n, \r\n or \r at line ends folded to \n.

    A // line is one whose line ends right behind the slashes. Files are cut at line starts of two slashes; what
    goes on behind them was no such line, and is joined to the text before.
    """
    cut = "\n//"
    meta = {"file": "file_path", "size": "file_size", "block": "file_block_start"}
    raw = spark.read.option("lineSep", cut).text(path).select("value", *[F.col(f"_metadata.{m}").alias(c) for c, m in meta.items()], F.monotonically_increasing_id().alias("n"))
    # Blocks of a file may be read in any order; rows of one are numbered as they stand in it.
    raw = raw.select("value", "file", "size", F.struct("block", "n").alias("at"), F.col("value").rlike(r"\A(\r|\n|\z)").alias("starts"))
    # A file's last text counts only if a // line ends it, which shows in the file's size; that of compressed files doesn't tell.
    per = raw.groupBy("file").agg(
        F.min("at").alias("first"), F.max("at").alias("last"), F.count_if(~F.col("starts")).alias("others"), F.min_by("starts", "at").alias("first_starts"),
        (F.sum(F.octet_length("value") + len(cut)) == F.first("size")).alias("ended"),
    )
    packed = F.col("file").rlike(COMPRESSED)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n")).where(packed & (F.trim("value") != ""))
    closed = lines.groupBy("file").agg((F.max_by("value", "n") == "//").alias("closed"))
    ended = F.coalesce(F.when(packed, F.col("closed")).otherwise(F.col("ended")), F.lit(False))
    per = per.join(closed, "file", "left").select("file", "first", F.when(~ended, F.col("last")).alias("open"), (F.col("others") > F.when(F.col("first_starts"), 0).otherwise(1)).alias("odd"))
    per = saved(per, "files")
    per = F.broadcast(per) if is_small(per) else per
    rows = raw.join(per, "file").withColumn("starts", F.col("starts") | (F.col("at") == F.col("first")))
    # Texts of files with other lines that start with slashes: counted within blocks, and blocks within files.
    some = rows.where("odd")
    blocks = some.groupBy("file", "at.block").agg(F.count_if("starts").alias("texts"))
    earlier = F.coalesce(F.sum("texts").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("file", "block", earlier.alias("earlier"))
    within = F.sum(F.col("starts").cast("long")).over(Window.partitionBy("file", "block").orderBy("at"))
    some = some.withColumn("block", F.col("at.block")).withColumn("within", within).join(blocks, ["file", "block"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), cut)
    some = some.groupBy("file", (F.col("earlier") + F.col("within")).alias("text")).agg(F.min("at").alias("at"), F.max("at").alias("until"), F.first("open").alias("open"), joined.alias("value"))
    whole = rows.where("NOT odd").select("file", "at", F.col("at").alias("until"), "open", "value").unionByName(some.drop("text"))
    value = F.regexp_replace(F.regexp_replace(F.col("value"), r"\r\n?", "\n"), r"\A\n?(?://(?:\n|\z))*|\n\z", "")
    return whole.where("open IS NULL OR until <> open OR value LIKE '%\n//'").select("file", "at", F.regexp_replace(value, r"\n//\z", "").alias("value"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(uniprot_id, sequence, sequence_length, organism, taxonomy_id) of flat files whose records end with a line //.

    Lines end with \n or \r\n; files may be compressed. Records without an id or a sequence are left out; of records of one id the
    last counts; text after the last // is no record.
    """
    rows = _terminated(spark, path)
    f = tagged_fields(F.col("value"))
    out = rows.select(F.struct("file", "at").alias("at"), S.first_accession(f["AC"]).alias("uniprot_id"), f["SQ"].alias("sequence"), f["OS"].alias("os"), f["OX"].alias("ox"))
    out = out.where("uniprot_id <> '' AND sequence <> ''")
    out = out.groupBy("uniprot_id").agg(F.max_by(F.struct("sequence", "os", "ox"), "at").alias("r"))
    return out.select("uniprot_id", "r.sequence", F.length("r.sequence").cast("long").alias("sequence_length"), F.coalesce("r.os", F.lit("Unknown")).alias("organism"), S.taxonomy_id(F.col("r.ox")).alias("taxonomy_id"))


def read_domains(spark: SparkSession, path: str, accession_column: int = 1) -> DataFrame:
    """A row a domain hit of a white-space table of 22 fixed fields and a description.

    Comment lines (#), short lines and lines with an unreadable number are skipped. accession_column: 1 is
    the table's accession, 0 its name (what some writers took for the accession).
    """
    raw = spark.read.text(path).where(~F.col("value").startswith("#"))
    f = F.split(F.trim("value"), r"\s+")
    at = lambda i: F.get(f, F.lit(i))
    numbers = {"evalue": (6, "double"), "score": (7, "double"), "bias": (8, "double"), "hmm_start": (15, "long"), "hmm_end": (16, "long"), "start": (17, "long"), "end": (18, "long"), "envelope_start": (19, "long"), "envelope_end": (20, "long")}
    out = raw.where(F.size(f) >= 22).select(
        S.query_id(at(3)).alias("uniprot_id"),
        S.accession_root(at(accession_column)).alias("accession"),
        at(0).alias("target_name"),
        F.array_join(F.slice(f, 23, 1 << 20), " ").alias("description"),
        *[at(i).try_cast(kind).alias(name) for name, (i, kind) in numbers.items()],
    )
    return out.where(" AND ".join(f"`{n}` IS NOT NULL" for n in numbers))


def read_cross_references(spark: SparkSession, path: str) -> DataFrame:
    """A row a UNP cross-reference line of structure files: (file, chain, accession, db_id_code and four residue numbers)."""
    line = F.col("value")
    part = lambda a, b: F.trim(F.substring(line, a + 1, b - a))
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    raw = raw.where(line.startswith("DBREF ") & (F.length(line) > 41) & (part(26, 32) == "UNP"))
    out = raw.select(
        "file", part(12, 13).alias("chain"), part(33, 41).alias("accession"), part(42, 54).alias("db_id_code"),
        part(14, 18).try_cast("long").alias("pdb_start_res"), part(20, 24).try_cast("long").alias("pdb_end_res"),
        part(55, 60).try_cast("long").alias("db_start_res"), part(62, 67).try_cast("long").alias("db_end_res"),
    )
    return out.where("pdb_start_res IS NOT NULL AND pdb_end_res IS NOT NULL AND db_start_res IS NOT NULL AND db_end_res IS NOT NULL")


def read_alpha_carbons(spark: SparkSession, path: str) -> DataFrame:
    """(file, index, chain, residue_seq, residue_icode, x, y, z) of the CA atoms of each structure file's first model.

    Atoms are chosen by name alone. Structures of a single CA give no rows. Unreadable coordinates are skipped.
    """
    line = F.col("value")
    part = lambda a, b: F.trim(F.substring(line, a + 1, b - a))
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    ends = raw.where(line.startswith("ENDMDL")).groupBy("file").agg(F.min("at").alias("end"))
    atoms = raw.where(line.rlike(r"\A(ATOM  |HETATM)") & (part(12, 16) == "CA")).join(ends, "file", "left").where("end IS NULL OR at < end")
    got = atoms.select("file", "at", part(21, 22).alias("chain"), part(22, 26).try_cast("long").alias("residue_seq"), part(26, 27).alias("residue_icode"), part(30, 38).try_cast("double").alias("x"), part(38, 46).try_cast("double").alias("y"), part(46, 54).try_cast("double").alias("z"))
    w = Window.partitionBy("file")
    got = got.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL").withColumn("index", F.row_number().over(w.orderBy("at")).cast("long") - 1).withColumn("n", F.count("*").over(w))
    return got.where("n > 1").drop("at", "n")


def read_fasta_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (uniprot_id): the second |-separated field of every line with a bar."""
    parts = F.split("value", r"\|")
    return spark.read.text(path).where(F.col("value").contains("|")).select(F.get(parts, F.lit(1)).alias("uniprot_id")).distinct()


def list_files(spark: SparkSession, folder: str, suffix: str = ".pdb") -> DataFrame:
    """(path) of all files below folder whose names end with suffix in any case; Spark leaves empty files out."""
    glob = "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder).select("path")


def matching_files(files: DataFrame, ids: DataFrame) -> DataFrame:
    """Files whose name holds an id of ids (uniprot_id, compared with case)."""
    return files.withColumn("uniprot_id", S.model_file_id(F.col("path"))).join(ids, "uniprot_id", "left_semi")


def read_compressed_text(spark: SparkSession, path: str) -> DataFrame:
    """(value, file) lines of gzip files, inflated while they are read."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))


def read_keyed_json(spark: SparkSession, path: str, schema: StructType = schemas.INTEGRATED) -> DataFrame:
    """Rows of a JSON object id -> record; entries that are no objects are skipped; the key is uniprot_id; NaN is NULL."""
    raw = spark.read.text(path, wholetext=True)
    items = raw.select(F.explode(F.from_json("value", "map<string,string>", {"allowNonNumericNumbers": "true"})).alias("key", "text"))
    body = StructType([f for f in schema.fields if f.name not in ("uniprot_id", "uniprot_id_prefix")])
    items = items.where(F.col("text").startswith("{"))
    rows = items.select("key", F.from_json("text", body, {"allowNonNumericNumbers": "true"}).alias("r")).select(F.col("key").alias("uniprot_id"), "r.*")
    return schemas.aligned(schemas.clean(rows).withColumn("uniprot_id_prefix", S.prefix_key(F.col("uniprot_id"))), schema)


def read_dataset(spark: SparkSession, path: str, columns: list[str] | None = None, uniprot_id: str | None = None) -> DataFrame:
    """A Parquet dataset, with the named columns that it has; prefixes that it is partitioned by are strings. An id also prunes the partitions of its prefix."""
    found = spark.read.parquet(path).schema
    df = spark.read.schema(StructType([StructField(f.name, StringType()) if f.name.endswith("_prefix") else f for f in found])).parquet(path)
    if uniprot_id is not None:
        df = df.where(F.col("uniprot_id") == uniprot_id)
        if "uniprot_id_prefix" in df.columns:
            df = df.where(F.col("uniprot_id_prefix") == (uniprot_id[:1] or "?"))
    return df.select(*[c for c in columns if c in df.columns]) if columns else df


def file_counts(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows, before): rows of each data file, from its footer, and of all files earlier by path. Unreadable files count 0."""
    df = spark.read.option("ignoreCorruptFiles", "true").parquet(path)
    per = df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"))
    w = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    return per.withColumn("before", F.coalesce(F.sum("rows").over(w), F.lit(0)))


def global_index(spark: SparkSession, path: str) -> DataFrame:
    """The dataset with a column global_index, counted over files by path and rows in file order, without a global sort. Unreadable files have no rows."""
    df = spark.read.option("ignoreCorruptFiles", "true").parquet(path)
    file, row, before, name = (free_name(df, n) for n in ("__file", "__row", "__before", "global_index"))
    df = df.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
    starts = file_counts(spark, path).select(F.col("file").alias(file), F.col("before").alias(before))
    return df.join(F.broadcast(starts), file).withColumn(name, F.col(before) + F.col(row)).drop(file, row, before)


#: Files up to which only those that hold wanted rows are listed for a look-up; beyond them all are scanned.
LOOKUP_FILES = 10_000


def places(counts: DataFrame, wanted: DataFrame, index: str = "global_index") -> DataFrame:
    """(index, file, row): where each different number of wanted is, by file_counts; numbers out of range give no rows.

    Numbers and files meet in ranges as long as a file is on average, so that each is compared with few.
    """
    total, files = counts.agg(F.sum("rows"), F.count("*")).first()
    size = max(1, (total or 0) // max(1, files))
    spans = counts.where("rows > 0").withColumn("end", F.col("before") + F.col("rows"))
    spans = spans.withColumn("range", F.explode(F.sequence(F.floor(F.col("before") / size).cast("long"), F.floor((F.col("end") - 1) / size).cast("long"))))
    numbers = wanted.select(F.col(index).cast("long").alias("number")).where("number >= 0").distinct().withColumn("range", F.floor(F.col("number") / size).cast("long"))
    found = numbers.join(spans, "range").where("number >= before AND number < end")
    return found.select(F.col("number").alias(index), "file", (F.col("number") - F.col("before")).alias("row"))


def rows_at(spark: SparkSession, path: str, wanted: DataFrame, index: str = "global_index", missing: str = "raise") -> DataFrame:
    """The dataset's rows at the numbers of wanted (by global_index), with that column; only files that hold one are read.

    A number that is wanted several times gives its row as often. Null, negative or too large numbers raise an IndexError, or
    (missing="skip") give no rows. Unreadable files have no rows.
    """
    if missing not in ("raise", "skip"):
        raise ValueError("missing is raise or skip")
    counts = saved(file_counts(spark, path), "counts")
    at = saved(places(counts, wanted, index), "places")
    if missing == "raise":
        lost = wanted.select(F.col(index).cast("long").alias(index)).join(at, index, "left_anti").head(1)
        if lost:
            raise IndexError(f"no row has the number {lost[0][0]}")
    reader = spark.read.option("ignoreCorruptFiles", "true")
    held = [r["file"] for r in at.select("file").distinct().limit(LOOKUP_FILES + 1).collect()]
    df = reader.parquet(path)
    if len(held) <= LOOKUP_FILES:
        df = df.where(F.col("_metadata.file_path").isin(held))
    file, row, number = (free_name(df, n) for n in ("__file", "__row", index))
    df = df.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
    asked = wanted.select(F.col(index).cast("long").alias(index)).join(at, index).select(F.col("file").alias(file), F.col("row").alias(row), F.col(index).alias(number))
    return df.join(F.broadcast(asked) if is_small(asked) else asked, [file, row]).drop(file, row)


def numbered(df: DataFrame, key: list[str], name: str = "global_index") -> DataFrame:
    """df with the place of each row in the total order of key, from 0: rows of earlier range partitions plus the place within one.

    The sorted partitions are written once with their numbers, so that counts and rows come from the same partitions.
    """
    part, row, first = (free_name(df, n) for n in ("__part", "__row", "__first"))
    ordered = df.repartitionByRange(*key).sortWithinPartitions(*key).withColumn(part, F.spark_partition_id()).withColumn(row, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    ordered = saved(ordered, "ordered")
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = ordered.groupBy(part).agg(F.count("*").alias("rows")).select(part, F.coalesce(F.sum("rows").over(before), F.lit(0)).alias(first))
    return ordered.join(F.broadcast(starts), part).withColumn(name, F.col(first) + F.col(row)).drop(part, row, first)


def head(df: DataFrame, n: int, key: list[str]) -> DataFrame:
    """The first n rows in the order of key: each task keeps n, so that no sort of all rows is needed."""
    if n < 0:
        raise ValueError("n is negative")
    return df.orderBy(*key).limit(n)


def read_residues(spark: SparkSession, path: str) -> DataFrame:
    """Pre-computed rows of residues, JSON lines: (pdb_id, and the fields of schemas.RESIDUE); NaN is NULL, a missing field too."""
    schema = StructType([*_PDB.fields, *schemas.RESIDUE.fields])
    return schemas.clean(spark.read.schema(schema).option("allowNonNumericNumbers", "true").json(path))


def read_weights(spark: SparkSession, path: str) -> dict[str, float]:
    """A table of weights by residue or residue pair, from lines `key<tab>value`: at most a few hundred entries."""
    rows = spark.read.csv(path, sep="\t", schema="key string, value double").where("key IS NOT NULL AND value IS NOT NULL")
    out = {r["key"]: r["value"] for r in rows.limit(1_001).collect()}
    if len(out) > 1_000:
        raise ValueError("more than 1000 weights")
    return out


def object_store_options(endpoint: str, key: str, secret: str) -> dict[str, str]:
    """Hadoop settings of an S3-compatible store; they need its connector on the class path."""
    return {"fs.s3a.endpoint": endpoint, "fs.s3a.access.key": key, "fs.s3a.secret.key": secret, "fs.s3a.path.style.access": "true"}


def check_store(spark: SparkSession, path: str) -> None:
    """Raises a ConnectionError unless Spark reaches the store and folder of path."""
    from py4j.protocol import Py4JJavaError

    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where)
    except Py4JJavaError as e:
        raise ConnectionError(f"{path}: {e.java_exception.toString()}") from None


@dataclass
class Config:
    """Hyper-parameters with their defaults; unknown keys in a file raise."""

    embed_dim: int = 64
    num_filters: int = 64
    kernel_sizes: list[int] = field(default_factory=lambda: [3, 5, 7])
    protein_encode_dim: int = 32
    dropout: float = 0.4
    lr: float = 1e-3
    batch_size: int = 64
    epochs: int = 10
    num_workers: int = 10
    n_clusters: int = 10
    train_frac: float = 0.8
    log_interval: int = 10


def _scalar(text: str):
    """A YAML scalar or flow list: JSON where it is that, else true, false, null, or the bare or quoted text."""
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x.strip()) for x in text[1:-1].split(",") if x.strip()]
    if len(text) > 1 and text[0] == text[-1] == "'":
        return text[1:-1].replace("''", "'")
    if text.lower() in ("~", "null", "true", "false"):
        return {"true": True, "false": False}.get(text.lower())
    try:
        return json.loads(text)
    except ValueError:
        return text


def load_config(path: str) -> Config:
    """Config from a YAML file of one level: scalars, bare strings, flow lists and block lists. Unknown keys raise."""
    values, last = {}, None
    for line in Path(path).read_text().splitlines():
        line = re.sub(r"(^|\s)#.*", "", line).rstrip()
        item = line.strip()
        if not item or item == "---":
            continue
        if item == "-" or item.startswith("- "):
            if last is None or not isinstance(values[last], list | None):
                raise ValueError(f"a list item without a key: {item}")
            values[last] = [*(values[last] or []), _scalar(item[1:].strip())]
            continue
        key, colon, value = item.partition(":")
        if not colon:
            raise ValueError(f"no key: {item}")
        last = key.strip()
        values[last] = _scalar(value.strip()) if value.strip() else None
    unknown = set(values) - {f.name for f in fields(Config)}
    if unknown:
        raise TypeError(f"unknown settings: {sorted(unknown)}")
    return Config(**values)


STATS_KEYS = ("protein_mean", "protein_std", "residue_mean", "residue_std")


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """One row of the four arrays of a statistics file; a missing array raises."""
    df = spark.read.json(path, multiLine=True, schema=", ".join(f"{k} array<double>" for k in STATS_KEYS))
    row = df.first()
    if row is None or any(row[k] is None for k in STATS_KEYS):
        raise ValueError(f"{path} lacks one of {STATS_KEYS}")
    return df
