"""A corpus pipeline: quality rules, line dedup, n-gram Jaccard join, mixing, byte-level BPE.

Every stage takes what the one before kept; all but the last return the columns of documents. Other columns of
their input are dropped first, whatever their names. Nulls in any column, empty and very long texts, ties and repeated rows
are taken as the operators define them; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import bpe, line_dedup, mixing, ngram_join, quality
from seqloom.llm.common import saved, ship, sized, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the trees are fitted on the labelled ones of docs."""
    docs = docs.select(*COLUMNS)
    trees = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.judged(docs, trees).where("kept").select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines seen earlier; n_chars counts what is left. Those that lose all their words go."""
    ship(spark)
    out = line_dedup.deduped(docs.select(*COLUMNS), exact=1)
    gone = (F.col("__dropped") > 0) & ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return out.where(~gone).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates: five-word shingles, Jaccard 0.8 or more.

    Rows that are equal in all columns count as one; rows of one id and text that differ elsewhere stay or go together. Rows of an id with
    several texts aren't compared, and stay: the id doesn't say which text is meant. Documents without words stay, and so do all rows without an id.
    """
    ship(spark)
    docs = docs.select(*COLUMNS)
    text = F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull())
    per = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows"), F.min(text).alias("least"), F.max(text).alias("most"))
    repeated = saved(per.where("rows > 1").select("doc_id", (F.col("least") != F.col("most")).alias("several")), "repeated")
    several, repeated = sized(repeated.where("several").select("doc_id")), sized(repeated.select("doc_id"))
    found = ngram_join.classes(docs.join(several, "doc_id", "left_anti"), width=5, num=80)
    gone = found.where("id <> component_id").select(F.col("id").alias("doc_id"))
    out = docs.join(gone, "doc_id", "left_anti")
    again = out.join(repeated, "doc_id", "left_semi").dropDuplicates()
    return out.join(repeated, "doc_id", "left_anti").select(*COLUMNS).unionByName(again.select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources come near their target weights."""
    ship(spark)
    return mixing.mix(docs.select(*COLUMNS))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the token ids of every document; the ids are decoded and must give its text back."""
    ship(spark)
    return bpe.encode_documents(docs, decode=True)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", ngram_join_stage),
    ("mixing sources", mixing_stage),
    ("byte-level BPE", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: The stages hold trees, edit distances and merges, which SQL can't express; tests/llm compares them with brute force.
ORACLE_SQL = None
