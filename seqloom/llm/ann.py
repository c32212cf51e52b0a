"""Approximate nearest neighbours by multiprobe p-stable hashing.

Every vector is hashed by several tables of Gaussian projections cut into windows. A query visits, in
each table, the buckets that small shifts of its code reach, in order of estimated success (the summed
squared distances to the crossed window borders). Candidates of all tables merge per query and are
ranked by the exact measure.

Largest inner product becomes smallest Euclidean distance by one more coordinate that brings all
vectors to the length of the longest one; queries get 0 there.
"""

from __future__ import annotations

import itertools
import logging

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.llm.common import saved, table

_LOG = logging.getLogger(__name__)

TABLES = 4
FUNCTIONS = 5
#: Window width, as a part of the longest vector's length.
WIDTH = 1.4
#: Queries, chosen by a hash, on which the number of probes is fitted, and the recall it must reach there.
FIT_QUERIES = 128
FIT_RECALL = 0.96
#: Rows of a bucket that one task takes; larger buckets are cut by a hash of the id and queries visit every piece.
PIECE = 20_000
QUERY_BLOCK = 2_048


class Hashes:
    """The tables' projections, offsets and list of shifts."""

    def __init__(self, dim: int, longest: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.a = rng.standard_normal((TABLES, dim + 1, FUNCTIONS))
        self.b = rng.random((TABLES, FUNCTIONS))
        self.longest = longest or 1.0
        self.shifts = np.array(list(itertools.product((-1, 0, 1), repeat=FUNCTIONS)), dtype=np.int64)

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Queries are scaled to the longest length (the order of their neighbours doesn't change)."""
        if query:
            return np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))])
        y = x / self.longest
        return np.hstack([y, np.sqrt(np.maximum(0.0, 1.0 - (y * y).sum(axis=1, keepdims=True)))])

    def codes(self, x: np.ndarray, query: bool) -> tuple[np.ndarray, np.ndarray]:
        f = np.einsum("nd,ldk->nlk", self.lift(x, query), self.a) / WIDTH + self.b
        low = np.floor(f)
        return low.astype(np.int64), f - low

    def order(self, part: np.ndarray) -> np.ndarray:
        """For each row of part (rows, FUNCTIONS): indexes of shifts, most promising first."""
        cost = np.stack([part, np.zeros_like(part), 1.0 - part], axis=-1) ** 2
        total = sum(cost[:, k, self.shifts[:, k] + 1] for k in range(FUNCTIONS))
        return np.argsort(total, axis=1, kind="stable")

    @staticmethod
    def bucket(codes: np.ndarray) -> np.ndarray:
        out = np.zeros(codes.shape[:-1], dtype=np.int64)
        for k in range(codes.shape[-1]):
            out = out * 1_000_003 + codes[..., k]
        return out


def _matrix(raw: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype=np.float64).reshape(-1, dim)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part, v as doubles: not null, no null or non-finite component, not zero."""
    v = F.col(vec_col).cast("array<double>")
    ok = F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & (F.size(v) > 0)
    ok &= F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def _packed(rows: DataFrame) -> DataFrame:
    def pack(batches):
        for b in batches:
            yield pd.DataFrame({"vec_id": b["vec_id"], "v": [np.asarray(x, dtype=np.float64).tobytes() for x in b["v"]]})

    return rows.mapInPandas(pack, "vec_id long, v binary")


def _best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> pd.DataFrame:
    """The k best ids of x for each q, by exact scores that don't depend on where a row stands; an id of several vectors counts once, with its best."""
    out, most = [], k + len(ids) - len(np.unique(ids))
    for at in range(0, len(q), 256):
        score = q[at : at + 256] @ x.T
        score[q_ids[at : at + 256, None] == ids[None]] = -np.inf
        if score.shape[1] > most:
            edge = np.partition(score, score.shape[1] - most, axis=1)[:, -most]
        else:
            edge = np.full(len(score), -np.inf)
        slack = 1e-9 * np.maximum(1.0, np.abs(edge))
        r, c = np.nonzero((score >= (edge - np.where(np.isfinite(slack), slack, 0))[:, None]) & (score > -np.inf))
        exact = np.einsum("ij,ij->i", q[at + r], x[c])
        p = pd.DataFrame({"query_id": q_ids[at + r], "vec_id": ids[c], "score": exact})
        p = p.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable").drop_duplicates(["query_id", "vec_id"])
        out.append(p[p.groupby("query_id").cumcount() < k])
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def _top(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)


def _scan(queries: DataFrame, index: DataFrame, n_queries: int, n_index: int, dim: int, k: int) -> DataFrame:
    """Exact search of the given queries against all rows, in blocks of both."""
    blocks, parts = -(-n_queries // QUERY_BLOCK), max(1, -(-n_index // PIECE))
    x = index.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(0, blocks - 1)))))
    q = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(max(1, blocks)))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    # Both come from one table: their columns get names of their own.
    x = x.select(F.col("block").cast("int").alias("block"), F.col("part").cast("int").alias("part"), F.col("vec_id").alias("id"), F.col("v").alias("x"))
    q = q.select(F.col("block").cast("int").alias("q_block"), F.col("part").cast("int").alias("q_part"), F.col("vec_id").alias("q_id"), F.col("v").alias("q"))

    def group(a, b):
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return _best(a["q_id"].to_numpy(), _matrix(a["q"], dim), b["id"].to_numpy(), _matrix(b["x"], dim), k)

    return _top(q.groupBy("q_block", "q_part").cogroup(x.groupBy("block", "part")).applyInPandas(group, "query_id long, vec_id long, score double"), k)


def nearest(vectors: DataFrame, k: int = 20, query_every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k rows of largest inner product that hashing finds for each query.

    Queries are the rows whose id query_every divides; candidates all rows of another id. Unusable vectors
    (see usable) and those whose width isn't the most frequent one take no part. Rows of one id and vector
    count once; an id of several vectors is as near as the nearest of them, as query and as candidate. Ties go to the smaller id. A query with fewer than k finds is searched again exactly, in
    blocks. The number of probes is fitted on at most FIT_QUERIES queries, whose true neighbours are
    searched among all rows; all rows are indexed. If no number of probes reaches FIT_RECALL there, all
    queries are searched exactly. Which way was taken is logged. An empty table gives an empty result.
    """
    rows = usable(vectors, id_col, vec_col)
    shape = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).alias("longest")).orderBy(F.desc("n"), "dim").first()
    if shape is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n, longest = shape["dim"], shape["n"], shape["longest"]
    index = saved(_packed(rows.where(F.size("v") == dim).distinct()), "vectors")
    queries = index.where(F.col("vec_id") % query_every == 0)
    hashes = Hashes(dim, longest)

    fit = queries.orderBy(F.xxhash64("vec_id", F.lit(3))).limit(FIT_QUERIES)
    truth = _scan(fit, index, FIT_QUERIES, n, dim, k)
    probes, recall = _fit_probes(fit, truth, index, hashes, dim)
    if recall < FIT_RECALL:
        _LOG.warning("nearest: all %d probes reach a fitted recall of %.3f, under %.2f: all queries are searched exactly", probes, recall, FIT_RECALL)
        n_queries = queries.count()
        return _scan(queries, index, n_queries, n, dim, k).select("query_id", "rank", "vec_id", "score")
    _LOG.info("nearest: hashing with %d probes, fitted recall %.3f", probes, recall)

    def of_rows(batches):
        for b in batches:
            if len(b):
                codes, _ = hashes.codes(_matrix(b["v"], dim), False)
                for t in range(TABLES):
                    yield pd.DataFrame({"t": t, "bucket": Hashes.bucket(codes[:, t]), "vec_id": b["vec_id"], "v": b["v"]})

    def of_queries(batches):
        for b in batches:
            if len(b):
                codes, part = hashes.codes(_matrix(b["v"], dim), True)
                for t in range(TABLES):
                    near = hashes.shifts[hashes.order(part[:, t])[:, :probes]] + codes[:, t][:, None, :]
                    yield pd.DataFrame({"t": t, "bucket": list(Hashes.bucket(near)), "vec_id": b["vec_id"], "v": b["v"]})

    # A table's buckets are dealt to zones of about PIECE rows; a query is sent once to each zone that it visits, with its buckets.
    hashed = index.mapInPandas(of_rows, "t int, bucket long, vec_id long, v binary")
    zones = max(1, -(-n // PIECE))
    zone = lambda c: F.pmod(F.xxhash64(c), F.lit(zones)).cast("int")
    size = hashed.groupBy("t", "bucket").count()
    large = size.where(F.col("count") > PIECE).select("t", "bucket", F.ceil(F.col("count") / PIECE).cast("int").alias("pieces"))
    large = F.broadcast(large)  # fewer than n * TABLES / PIECE rows
    left = hashed.join(large, ["t", "bucket"], "left").withColumn("piece", F.pmod(F.xxhash64("vec_id"), F.coalesce("pieces", F.lit(1))).cast("int"))
    left = left.select("t", zone("bucket").alias("zone"), "piece", "bucket", "vec_id", "v")
    visits = queries.mapInPandas(of_queries, "t int, bucket array<long>, vec_id long, v binary")
    visits = visits.withColumn("zone", F.explode(F.array_distinct(F.transform("bucket", zone))))
    visits = visits.withColumn("bucket", F.filter("bucket", lambda c: zone(c) == F.col("zone")))
    most = large.groupBy("t", zone("bucket").alias("zone")).agg(F.max("pieces").alias("pieces"))
    visits = visits.join(F.broadcast(most), ["t", "zone"], "left").withColumn("piece", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)))
    # A zone's queries are cut into blocks, too; its rows go to each of them once.
    blocks = visits.groupBy("t", "zone").agg(F.ceil(F.count_distinct("vec_id") / QUERY_BLOCK).cast("int").alias("blocks"))
    blocks = F.broadcast(saved(blocks, "blocks"))  # a row a zone and table: fewer than n * TABLES / PIECE and TABLES
    visits = visits.join(blocks, ["t", "zone"]).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.col("blocks")).cast("int"))
    visits = visits.select("t", "zone", "piece", "block", "bucket", "vec_id", "v")
    left = left.join(blocks, ["t", "zone"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def group(a, b):
        """Of a zone: each bucket's rows against the queries that visit it."""
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        if not len(a) or not len(b):
            return empty
        q_ids, q = a["vec_id"].to_numpy(), _matrix(a["v"], dim)
        counts = a["bucket"].map(len).to_numpy()
        visit, who = np.concatenate(a["bucket"].to_list()), np.repeat(np.arange(len(a)), counts)
        order = np.argsort(visit, kind="stable")
        visit, who = visit[order], who[order]
        code, ids, x = b["bucket"].to_numpy(), b["vec_id"].to_numpy(), _matrix(b["v"], dim)
        by = np.argsort(code, kind="stable")
        cut = np.flatnonzero(np.diff(code[by])) + 1
        out = []
        for rows_ in np.split(by, cut):
            lo, hi = np.searchsorted(visit, code[rows_[0]], "left"), np.searchsorted(visit, code[rows_[0]], "right")
            if hi > lo:
                out.append(_best(q_ids[who[lo:hi]], q[who[lo:hi]], ids[rows_], x[rows_], k))
        if not out:
            return empty
        p = pd.concat(out).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).drop_duplicates(["query_id", "vec_id"])
        return p[p.groupby("query_id").cumcount() < k]

    key = ["t", "zone", "piece", "block"]
    pairs = visits.groupBy(*key).cogroup(left.groupBy(*key)).applyInPandas(group, "query_id long, vec_id long, score double")
    found = saved(_top(pairs, k), "found")
    full = found.groupBy("query_id").count().where(F.col("count") >= min(k, n)).select(F.col("query_id").alias("vec_id"))
    short = queries.join(full, "vec_id", "left_anti")
    n_short = short.count()
    if n_short:
        again = _scan(short, index, n_short, n, dim, k)
        found = found.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(again)
    return found.select("query_id", "rank", "vec_id", "score")


def _fit_probes(fit: DataFrame, truth: DataFrame, index: DataFrame, hashes: Hashes, dim: int) -> tuple[int, float]:
    """The fewest probes that find FIT_RECALL of truth (all, if none do) and the recall they reach.

    The rows of truth (FIT_QUERIES * k at most) reach the driver.
    """
    near = truth.select("query_id", "vec_id").join(index, "vec_id").toPandas()
    q = fit.toPandas()
    if not len(near):
        return len(hashes.shifts), 1.0
    q_codes, part = hashes.codes(_matrix(q["v"], dim), True)
    codes, _ = hashes.codes(_matrix(near["v"], dim), False)
    at = pd.Series(np.arange(len(q)), index=q["vec_id"])
    at = at[~at.index.duplicated()].loc[near["query_id"]].to_numpy()
    best = np.full(len(near), len(hashes.shifts))
    for t in range(TABLES):
        rank = np.argsort(hashes.order(part[:, t]), axis=1)
        gap = codes[:, t] - q_codes[at, t]
        number = ((gap + 1) * 3 ** np.arange(FUNCTIONS)[::-1]).sum(axis=1)
        seen = (np.abs(gap) <= 1).all(axis=1)
        best = np.where(seen, np.minimum(best, rank[at, np.where(seen, number, 0)]), best)
    for probes in range(1, len(hashes.shifts) + 1):
        recall = float((best < probes).mean())
        if recall >= FIT_RECALL:
            break
    return probes, recall


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of every 20th vector; see nearest for unusable vectors, ties, repeated rows and empty tables."""
    return nearest(table(spark, sf_dir, "embeddings"))
