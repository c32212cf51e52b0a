"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a side of fixed-width rows is broadcast; larger sides are shuffled.
BROADCAST_ROWS = 500_000

#: Bytes of texts up to which a side that has them is broadcast.
BROADCAST_BYTES = 32 << 20

#: Partitions of a graph whose nodes are few enough to be broadcast.
SMALL_GRAPH_PARTS = 16


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a session, unless their PYTHONPATH already has it."""
    root = Path(__file__).resolve().parents[2]
    context = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(":") or getattr(context, "_seqloom_shipped", False):
        return
    to = Path(tempfile.mkdtemp(prefix="seqloom-")) / "seqloom.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted((root / "seqloom").rglob("*.py")):
            z.write(p, p.relative_to(root))
    context.addPyFile(str(to))
    context._seqloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder that driver and executors share.

    It lies in the cluster's spark.checkpoint.dir. Only where that is unset in a local session is a folder of
    this machine used; a cluster without it raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir, a folder that all executors share, is unset")
        root = f"file://{tempfile.mkdtemp(prefix='seqloom-')}"
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def saved(df: DataFrame, purpose: str, compression: str | None = None) -> DataFrame:
    """df written to the shared folder and read again: later steps don't recompute it, nor does a lost executor."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes what saved() wrote, once no later step reads it."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._saved_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Has the driver collect its garbage between the steps of a long operator.

    Only then does Spark drop broadcasts and shuffle files that no later step reads, and does the driver's heap shrink to what lives.
    """
    gc.collect()
    spark._jvm.System.gc()


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most limit rows, otherwise unchanged (Spark then shuffles)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def sized_texts(df: DataFrame, text: str, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if it has at most `rows` rows, whose texts in the column named text have at most `most` bytes; otherwise unchanged."""
    got = df.agg(F.count("*"), F.sum(F.octet_length(text))).first()
    return F.broadcast(df) if got[0] <= rows and (got[1] or 0) <= most else df


def most_counted(counts: DataFrame, name: str, most: int) -> DataFrame:
    """The rows of counts with the largest values of the column name (1 or more), at most `most`; rows of near values stay or go together.

    Only a histogram of a few thousand rows reaches the driver, so that no task has to sort the rows.
    """
    if counts.count() <= most:
        return counts
    step = F.floor(F.log2(F.col(name)) * 100).cast("int")
    total, least = 0, 1 << 30
    for r in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).toLocalIterator():
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    return counts.where(step >= least)


def free_name(df: DataFrame, name: str) -> str:
    """name, prefixed until no column of df has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def column(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): returns (node, component), component the smallest node.

    Alternates large-star and small-star steps; every step is an aggregation and a join over edges,
    and is written to the shared folder. Neither nodes nor edges reach the driver.
    Nulls take no part; an empty table gives an empty one.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = saved(e, "edges")
    before, n = None, e.count()
    for _ in range(rounds):
        # n edges have 2 n nodes at most, which bounds the side that is broadcast.
        few = 2 * n <= BROADCAST_ROWS
        side = (lambda df: F.broadcast(df.coalesce(SMALL_GRAPH_PARTS))) if few else (lambda df: df)
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(side(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b") if few else large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(side(least), "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("p"))
        small = small.select("p.a", "p.b").where("a <> b").distinct()
        e = saved(small.coalesce(SMALL_GRAPH_PARTS) if few else small, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, n = now, now[0]
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    least = e.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    roots = least.select(F.col("component").alias("node"), "component").distinct()
    return least.union(roots)
