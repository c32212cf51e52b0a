"""Centroid clustering of integer vectors, exact to the last bit.

Components become integers, floor(SCALE * x), so that assignments, sums and distances don't depend on the order of
additions. Distances are |x|² - 2 x·c + |c|² with one matrix product a block of vectors, in float64: exact while every
partial result stays below 2^53, which bounds on the largest components of block and centroids prove. Blocks
beyond the bound are computed in 64-bit integers, and blocks beyond those in integers of any size.

Vectors are packed once into blocks of rows in the shared folder. A round is one pass over the blocks: each task gives a
sum and a count a centroid, and treeAggregate adds them up, so that the driver sees k sums whatever the number of vectors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import column, forget, saved, ship, table

WIDTH, SCALE, K, ROUNDS = 64, 64, 16, 3
#: Vectors of a block, at most.
BLOCK = 8192
_LONG = 1 << 63


def whole(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) for finite doubles: int64, or Python integers where one doesn't fit half of that (scale: a power of two)."""
    if not x.size or np.abs(x).max() < 2.0**61 / scale:
        return np.floor(x * scale).astype(np.int64)
    # Doubles of 2^53 or more are integers already.
    flat = [int(v) * scale if abs(v) >= 2.0**53 else int(np.floor(v * scale)) for v in x.ravel().tolist()]
    return np.array(flat, dtype=object).reshape(x.shape)


def _most(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's nearest centroid (ties: the smaller) and the squared distance: int64, or Python integers beyond them."""
    n, width = x.shape
    # No partial result of the expansion, nor of the squared differences, exceeds this.
    bound = width * (_most(x) + _most(c)) ** 2
    if bound < 1 << 53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        d = (a * a).sum(axis=1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(axis=1)[None, :]
    else:
        kind = np.int64 if bound < _LONG else object
        a, b = x.astype(kind), c.astype(kind)
        d = np.empty((n, len(c)), dtype=kind)
        for j in range(len(c)):
            part = a - b[j]
            d[:, j] = (part * part).sum(axis=1)
    # argmin keeps the first of equal ones.
    at = np.argmin(d, axis=1) if n else np.zeros(0, dtype=np.int64)
    least = d[np.arange(n), at]
    return at, least if least.dtype == object else least.astype(np.int64)


def _sums(at: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """Sums of the rows of values by centroid, as Python integers."""
    out = np.zeros((k, values.shape[1]), dtype=object)
    for j in np.unique(at).tolist():
        part = values[at == j]
        exact = part.dtype == object or _most(part) * len(part) >= _LONG
        out[j] = part.astype(object).sum(axis=0) if exact else [int(v) for v in part.sum(axis=0)]
    return out


def _vectors(df: DataFrame, id_col: str, vec_col: str, width: int) -> DataFrame:
    """(id, v): the vectors that take part."""
    v = column(vec_col).cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return df.select(column(id_col).cast("long").alias("id"), v.alias("v")).where((F.size("v") == width) & F.forall("v", fine))


def _pack(vectors: DataFrame, width: int, scale: int) -> DataFrame:
    """(rows, kind, data): blocks of integer vectors, in the narrowest kind of integer that holds them; beyond int64 the doubles stay."""

    def pack(batches):
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                x = b.column("v")[i : i + BLOCK].flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                w = whole(x, scale)
                if w.dtype == object:
                    kind, w = "f8", x
                else:
                    kind = next(t for t in ("i1", "i2", "i4", "i8") if _most(w) <= np.iinfo(t).max)
                yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int32()), pa.array([kind]), pa.array([w.astype(f"<{kind}").tobytes()], pa.binary())], ["rows", "kind", "data"])

    return vectors.mapInArrow(pack, "rows int, kind string, data binary")


def _unpack(row, width: int, scale: int) -> np.ndarray:
    x = np.frombuffer(bytes(row["data"]), dtype=f"<{row['kind']}").reshape(row["rows"], width)
    return whole(x, scale) if row["kind"] == "f8" else x.astype(np.int64)


def _add(a, b):
    return b if a is None else a if b is None else tuple(x + y for x, y in zip(a, b, strict=True))


def _hash(order: Column, prefix: str) -> Column:
    return F.sha2(F.concat(F.lit(prefix), order.cast("string")).cast("binary"), 256)


def clustered(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", width: int = WIDTH, scale: int = SCALE, k: int = K, rounds: int = ROUNDS, prefix: str = "1:") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part.

    These have exactly width components, none null or not finite; null and other vectors are left out. Components
    become floor(scale * x). Centroids start as the k vectors with the smallest sha256 of prefix and id (fewer vectors: fewer
    centroids), ties by the vector itself; vectors of a null id come last there. Repeated rows are as many vectors. In each round all
    vectors go to the nearest centroid by squared distance (ties: the smaller number), and a centroid with vectors becomes the floors of their means. Then
    vectors are assigned once more. inertia sums distances over all vectors; a distance or sum that a long can't hold is
    null. centroid_sha256: of the centroid's integers, joined by commas. An empty table gives no rows; other columns aren't read.
    """
    ship(df.sparkSession)
    context = df.sparkSession.sparkContext
    vectors = _vectors(df, id_col, vec_col, width)
    schema = "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    first = vectors.orderBy(_hash(F.col("id"), prefix).asc_nulls_last(), "v").limit(k).select("v").collect()
    if not first:
        return df.sparkSession.createDataFrame([], schema)
    centroids = whole(np.array([r["v"] for r in first], dtype=np.float64).reshape(-1, width), scale)
    k = len(centroids)
    blocks = saved(_pack(vectors, width, scale), "blocks")
    rows = blocks.rdd

    def one_round(c: np.ndarray, step):
        sent = context.broadcast(c)
        got = rows.treeAggregate(None, lambda total, row: _add(total, step(_unpack(row, width, scale), sent.value)), _add)
        sent.destroy()
        return got

    def moved(x, c):
        at = nearest(x, c)[0]
        return _sums(at, x, k), np.bincount(at, minlength=k).astype(object)

    def spread(x, c):
        at, d = nearest(x, c)
        return (_sums(at, d[:, None], k)[:, 0],)

    for _ in range(rounds):
        total, count = one_round(centroids, moved)
        new = [[int(s) // int(n) for s in row] if n else row_was for row, n, row_was in zip(total, count, centroids.tolist(), strict=True)]
        fits = max(abs(v) for row in new for v in row) < _LONG
        centroids = np.array(new, dtype=np.int64 if fits else object)
    inertia = [int(v) for v in one_round(centroids, spread)[0]]
    forget(blocks)

    fit = lambda v: int(v) if -_LONG <= v < _LONG else None
    facts = [(fit(v), fit(sum(inertia)), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for v, c in zip(inertia, centroids.tolist(), strict=True)]
    sent = context.broadcast((centroids, facts))

    def label(batches):
        c, f = sent.value
        for b in batches:
            x = whole(b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width), scale)
            at, d = nearest(x, c)
            columns = [b.column("id"), pa.array(at, pa.int32()), pa.array([fit(v) for v in d.tolist()], pa.int64())]
            take = pa.array(at)
            columns += [pa.array([r[i] for r in f], kind).take(take) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return vectors.mapInArrow(label, schema)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all embeddings; see clustered for what takes part, ties, repeated rows and empty tables."""
    return clustered(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).withColumnRenamed("id", "vec_id")


_ASSIGNED = """
d{r} AS MATERIALIZED (SELECT x.row, c.cluster, sum((x.x - c.x) * (x.x - c.x)) AS distance FROM parts x JOIN c{r} c USING (pos) GROUP BY x.row, c.cluster),
a{r} AS MATERIALIZED (SELECT row, min(distance) AS distance, arg_min(cluster, distance * 1000 + cluster) AS cluster FROM d{r} GROUP BY row)"""
_MOVED = """
m{r} AS (SELECT a.cluster, x.pos, sum(x.x) AS s, count(*) AS n FROM a{r} a JOIN parts x USING (row) GROUP BY a.cluster, x.pos),
c{s} AS MATERIALIZED (SELECT c.cluster, c.pos, CASE WHEN m.n IS NULL THEN c.x ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS x FROM c{r} c LEFT JOIN m{r} m USING (cluster, pos))"""

OP13_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda v: CAST(floor({SCALE} * CAST(v AS DOUBLE)) AS HUGEINT)) AS v FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = {WIDTH}
),
parts AS MATERIALIZED (SELECT row, generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM kept),
starts AS (SELECT row, row_number() OVER (ORDER BY sha256('1:' || vec_id), row) - 1 AS cluster FROM kept QUALIFY cluster < {K}),
c0 AS MATERIALIZED (SELECT cluster, pos, x FROM starts JOIN parts USING (row)),
{",".join(_ASSIGNED.format(r=r) + "," + _MOVED.format(r=r, s=r + 1) for r in range(ROUNDS))},
{_ASSIGNED.format(r=ROUNDS)},
named AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY pos)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY cluster)
SELECT kept.vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN kept USING (row) JOIN named USING (cluster)
"""
