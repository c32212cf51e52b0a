"""Tables between steps in the folder that driver and executors share, the package on executors, and free column names."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows of small fixed-width columns up to which a side is broadcast; larger sides are shuffled.
BROADCAST_ROWS = 500_000


def folder(spark: SparkSession, purpose: str) -> str:
    """A new folder in the one that executors share; only a local session may go without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir, a folder that all executors share, is unset")
        root = "file://" + os.path.join(tempfile.gettempdir(), "seqloom")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """df as a table in the shared folder: cuts its lineage, and is there when an executor is lost."""
    path = folder(df.sparkSession, purpose)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes what saved() wrote, once no later step reads it."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._saved_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def is_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most limit rows; no more than these are counted."""
    return df.limit(limit + 1).count() <= limit


def free_name(df: DataFrame, name: str) -> str:
    """name, prefixed until no column of df has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a session, unless their PYTHONPATH already has it."""
    root, context = Path(__file__).resolve().parents[1], spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(":") or getattr(context, "_seqloom_shipped", False):
        return
    to = Path(tempfile.mkdtemp(prefix="seqloom-")) / "seqloom.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted((root / "seqloom").rglob("*.py")):
            z.write(p, p.relative_to(root))
    context.addPyFile(str(to))
    context._seqloom_shipped = True
