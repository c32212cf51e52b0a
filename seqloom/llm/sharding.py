"""Sharding by size-tiered compaction.

A store is a folder of immutable Parquet files and numbered manifests. Arrivals are appended as small
shards. Compaction takes files of one size tier, merges runs of them into files of up to the target
size, and commits a new manifest; readers of an older version aren't disturbed. Only lists of files
(one entry a file) are on the driver. A task merges one run by reading its files in turn: no shuffle.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import shared_folder, table

TARGET_BYTES = 128 << 20
#: Files of a tier from which they are merged, and how much larger the next tier's files are.
FANOUT = 4
#: Sizes below this are one tier.
LEAST_BYTES = 1 << 20
#: Runs that one Spark job merges.
RUNS_PER_JOB = 200


class ShardStore:
    """A versioned set of shards under root, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    def _path(self, p: str):
        return self._hadoop.fs.Path(p)

    def versions(self) -> list[int]:
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """{version, schema, shards: [{path, bytes, seq}]} of a version, or of the newest; version 0 is the empty store."""
        have = self.versions()
        if version is None:
            version = have[-1] if have else 0
        if version == 0:
            return {"version": 0, "schema": None, "shards": []}
        text = self.spark.read.option("wholetext", True).text(f"{self.root}/manifests/{version:010d}.json").first()[0]
        return json.loads(text)

    def commit(self, based_on: dict, shards: list[dict], schema: str) -> int:
        """Makes shards the next version after based_on. Raises if another commit took that number.

        The number is claimed by creating a file without overwriting (one step on HDFS and local disks, and on stores whose
        connector puts conditionally); the manifest is written aside and renamed, so that readers see it whole. The claim of a
        writer that died is removed by vacuum().
        """
        version = based_on["version"] + 1
        name = f"{self.root}/manifests/{version:010d}"
        final, aside = self._path(f"{name}.json"), self._path(f"{self.root}/manifests/{uuid.uuid4().hex}.tmp")
        try:
            self._fs.create(self._path(f"{name}.claim"), False).close()
        except Exception as e:
            if "exist" not in str(e):
                raise
            raise RuntimeError(f"version {version} was committed by another writer") from e
        out = self._fs.create(aside, False)
        out.write(json.dumps({"version": version, "schema": schema, "shards": shards}).encode())
        out.close()
        if self._fs.exists(final) or not self._fs.rename(aside, final):
            self._fs.delete(aside, False)
            raise RuntimeError(f"version {version} was committed by another writer")
        return version

    def _written(self, folder: str, seq: int) -> list[dict]:
        """The data files of a folder in the order of their tasks, those without rows too."""
        found = sorted((f.getPath().getName(), f.getLen()) for f in self._fs.listStatus(self._path(folder)))
        return [{"path": f"{folder}/{name}", "bytes": size, "seq": seq + i} for i, (name, size) in enumerate(x for x in found if x[0].startswith("part-"))]

    def append(self, df: DataFrame) -> int:
        """Adds the rows of df as new shards, one a task, and returns the new version. df must have the store's schema."""
        now = self.manifest()
        schema = df.schema.json()
        if now["schema"] and [f.dataType for f in df.schema] != [f.dataType for f in self._schema(now)]:
            raise ValueError("the rows have another schema than the store")
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(folder)
        seq = 1 + max((s["seq"] for s in now["shards"]), default=-1)
        return self.commit(now, now["shards"] + self._written(folder, seq), now["schema"] or schema)

    @staticmethod
    def _schema(manifest: dict):
        from pyspark.sql.types import StructType

        return StructType.fromJson(json.loads(manifest["schema"]))

    @staticmethod
    def tier(size: int, fanout: int = FANOUT) -> int:
        return 0 if size < LEAST_BYTES else 1 + int(math.log(size / LEAST_BYTES, fanout))

    @staticmethod
    def runs(shards: list[dict], target: int, fanout: int = FANOUT) -> list[list[dict]]:
        """Runs of at least two similarly sized shards, each up to the target size; smaller tiers first, oldest first.

        A tier is merged once it has fanout shards. Shards of half the target or more are done.
        """
        tiers: dict[int, list[dict]] = {}
        for s in sorted(shards, key=lambda s: s["seq"]):
            if s["bytes"] < target / 2:
                tiers.setdefault(ShardStore.tier(s["bytes"], fanout), []).append(s)
        out = []
        for _, members in sorted(tiers.items()):
            if len(members) < fanout:
                continue
            run, size = [], 0
            for s in members:
                if run and size + s["bytes"] > target:
                    out.append(run)
                    run, size = [], 0
                run.append(s)
                size += s["bytes"]
            out.append(run)
        return [r for r in out if len(r) > 1]

    def compact(self, target: int = TARGET_BYTES, fanout: int = FANOUT) -> int:
        """Merges until no tier has fanout shards; each round is one commit. Returns the newest version."""
        while runs := self.runs((now := self.manifest())["shards"], target, fanout):
            schema = self._schema(now)
            merged, seq = [], 1 + max(s["seq"] for s in now["shards"])
            for at in range(0, len(runs), RUNS_PER_JOB):
                parts = [self.spark.read.schema(schema).parquet(*[s["path"] for s in run]).coalesce(1) for run in runs[at : at + RUNS_PER_JOB]]
                together = parts[0]
                for p in parts[1:]:
                    together = together.union(p)
                folder = f"{self.root}/data/{uuid.uuid4().hex}"
                together.write.option("compression", "zstd").parquet(folder)
                merged += self._written(folder, seq + len(merged))
            gone = {s["path"] for run in runs for s in run}
            self.commit(now, [s for s in now["shards"] if s["path"] not in gone] + merged, now["schema"])
        return self.manifest()["version"]

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, or of the newest."""
        m = self.manifest(version)
        if m["schema"] is None:
            raise ValueError("the store has no version yet")
        paths = [s["path"] for s in m["shards"]]
        schema = self._schema(m)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes manifests but the newest `keep`, shards that none of these needs, and what writers that died have left; returns how many shards went.

        To be called while no writer is at work.
        """
        have = self.versions()
        needed = {s["path"].rsplit("/data/", 1)[-1] for v in have[-keep:] for s in self.manifest(v)["shards"]}
        for v in have[:-keep]:
            self._fs.delete(self._path(f"{self.root}/manifests/{v:010d}.json"), False)
        for f in self._fs.listStatus(self._path(f"{self.root}/manifests")):
            number, _, kind = f.getPath().getName().partition(".")
            if kind == "tmp" or kind == "claim" and int(number) > max(have, default=0):
                self._fs.delete(f.getPath(), False)
        gone, data = 0, self._path(f"{self.root}/data")
        for folder in self._fs.listStatus(data) if self._fs.exists(data) else ():
            for f in self._fs.listStatus(folder.getPath()):
                name = f.getPath().getName()
                if name.startswith("part-") and f"{folder.getPath().getName()}/{name}" not in needed:
                    gone += self._fs.delete(f.getPath(), False)
        return gone


#: Of the query's arrivals, by a hash of the id: each takes up to this of 16 parts of the documents.
ARRIVALS = (8, 12, 14, 15, 16)


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appends all documents in five arrivals of falling size, compacts, vacuums, and reads the newest version.

    Null ids and texts pass through; repeated rows stay repeated; an empty table makes an empty version.
    """
    docs = table(spark, sf_dir, "documents")
    store = ShardStore(spark, shared_folder(spark, "shards"))
    slot, low = F.pmod(F.xxhash64("doc_id"), F.lit(16)), 0
    for high in ARRIVALS:
        store.append(docs.where((slot >= low) & (slot < high)))
        low = high
    store.compact()
    store.vacuum()
    return store.read().select("doc_id", "lang", "source", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


OP9_SQL = "SELECT doc_id, lang, source, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5 FROM documents"
