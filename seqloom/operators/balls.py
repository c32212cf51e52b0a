"""A tree of balls over unit vectors, and the pairs of its leaves that may hold near vectors.

A ball has a centre (one of its vectors) and a covering radius, the largest angle from the centre to a member. Balls with too
many members are cut into children around centres of their own, level by level. Pairs of balls are followed from the root down
the tree, on both sides at once: a pair goes on only if the angle between its centres less both radii is within reach (angles obey the triangle
inequality). What is left are pairs of leaves, whose members are compared by one matrix product a pair.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.storage import forget, is_small, saved, ship

#: Children of a ball, at most; members of a leaf; levels. Members that no centre tells apart within these levels are cut by a hash into blocks of a leaf's size.
CHILDREN, LEAF, LEVELS = 16, 2_000, 12
#: Bounds are wider by this angle: the arc cosine of nearly equal vectors is that inexact.
SLACK = 1e-6
#: Bytes of vectors, or of centres, up to which they are broadcast; more are shuffled.
BROADCAST_BYTES = 64 << 20
#: Groups of leaves whose pairs are tiles, at least, and vectors of a group, at most about.
GROUPS, GROUP_MEMBERS = 24, 100_000
#: Pairs of vectors that a task compares, about, where blocks are broadcast.
WORK = 50_000_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def angle(a: Column, b: Column) -> Column:
    """The angle between two unit vectors."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b))))


@dataclass
class Balls:
    """members (id, u, ball) and leaves (ball, center, radius, n, first: the smallest id) of a tree, and its levels (parent, ball, center, radius, n) from the root down."""

    members: DataFrame
    leaves: DataFrame
    levels: list[DataFrame]
    width: int

    def forget(self) -> None:
        for df in (self.members, self.leaves, *self.levels):
            forget(df)


def _small(rows: int, width: int) -> bool:
    return rows * (8 * width + 32) <= BROADCAST_BYTES


def _sided(df: DataFrame, width: int) -> DataFrame:
    """df, a vector a row, marked for broadcast if it is small."""
    return F.broadcast(df) if is_small(df, BROADCAST_BYTES // (8 * width + 32)) else df


def tree(units: DataFrame, leaf: int = LEAF, children: int = CHILDREN, dense_radius: float | None = None, dense: int = 0) -> Balls | None:
    """The tree of unit vectors (id, u), all of one width; None without any.

    Balls of more than `leaf` members are cut. With a dense_radius, members within it of their centre are a ball apart from those farther out, which isn't
    cut any more if it has at least `dense` members.
    """
    rings = 1 if dense_radius is None else 2
    if not 2 <= children * rings <= 2 * CHILDREN:
        raise ValueError(f"a ball has from 2 to {CHILDREN} children")
    rows = saved(units.select("id", "u", F.lit(0).cast("long").alias("ball")), "members")
    head = rows.select(F.size("u").alias("w")).first()
    if head is None:
        forget(rows)
        return None
    width = head["w"]
    done, levels, kept = [], [], []
    facts = None
    for level in range(LEVELS):
        # The balls to be cut: at the root all.
        n = rows.count() if facts is None else 0
        cut = rows.select("ball").distinct().select("ball", F.lit(n).cast("long").alias("n")) if facts is None else facts.where("grow").select("ball", "n")
        pieces = F.least(F.lit(children), (2 * F.ceil(F.col("n") / leaf)).cast("int"))
        at = rows.join(F.broadcast(cut) if is_small(cut) else cut, "ball").withColumn("salt", F.pmod(F.xxhash64(F.lit(level), "id"), F.greatest(pieces, F.lit(1))).cast("int"))
        order = F.struct(F.xxhash64(F.lit(-1 - level), "id"), "id")
        centers = at.groupBy("ball", "salt").agg(F.min_by("u", order).alias("center"))
        centers = centers.groupBy("ball").agg(F.array_sort(F.collect_list(F.struct("salt", "center"))).alias("centers"))
        centers = saved(centers, "centers")
        both = at.drop("salt", "n").join(_sided(centers, width * children), "ball")
        angles = F.transform("centers", lambda c: angle(c["center"], F.col("u")))
        near = both.withColumn("angles", angles).withColumn("angle", F.array_min("angles"))
        place = (F.array_position("angles", F.col("angle")) - 1).cast("int")
        ring = F.lit(0) if dense_radius is None else (F.col("angle") > dense_radius).cast("int")
        child = (F.col("ball") * F.lit(children * rings) + F.get("centers", place)["salt"] * rings + ring + 1).alias("ball")
        moved = saved(near.select("id", "u", F.col("ball").alias("parent"), child, "angle", F.get("centers", place)["center"].alias("center")), "members")
        per = moved.groupBy("parent", "ball").agg(F.first("center").alias("center"), F.max("angle").alias("radius"), F.count("*").alias("n"), F.min("id").alias("first"))
        tight = F.lit(False) if dense_radius is None else (F.col("radius") <= dense_radius) & (F.col("n") >= dense)
        grow = (F.col("n") > leaf) & (F.col("radius") > 4 * SLACK) & ~tight & F.lit(level + 1 < LEVELS)
        facts = saved(per.withColumn("grow", grow).withColumn("tight", tight), "balls")
        levels.append(facts)
        stay = facts.where("NOT grow").select("ball")
        done.append(moved.join(F.broadcast(stay) if is_small(stay) else stay, "ball", "left_semi").select("id", "u", "ball"))
        kept += [rows, centers, moved]
        if facts.where("grow").isEmpty():
            break
        more = facts.where("grow").select("ball")
        rows = saved(moved.join(F.broadcast(more) if is_small(more) else more, "ball", "left_semi").select("id", "u", "ball"), "members")
    members = done[0]
    for d in done[1:]:
        members = members.unionByName(d)
    leaves = levels[0].where("NOT grow")
    for f in levels[1:]:
        leaves = leaves.unionByName(f.where("NOT grow"))
    out = Balls(saved(members, "members"), saved(leaves.drop("grow", "parent"), "leaves"), levels, width)
    for df in kept:
        forget(df)
    return out


def pairs_within(balls: Balls, reach: float, width_bound: int | None = None) -> DataFrame:
    """(x, y, nx, ny, least, most): pairs x <= y of leaves whose members may be within the angle reach; no member pair is nearer than least or farther than most."""
    got = None
    width = width_bound or balls.width
    for i, level in enumerate(balls.levels):
        kids = level.select("parent", "ball", "center", "radius", "n")
        # Balls that weren't cut any more go on as they are.
        for earlier in balls.levels[:i]:
            kids = kids.unionByName(earlier.where("NOT grow").select(F.col("ball").alias("parent"), "ball", "center", "radius", "n"))
        x = kids.select(F.col("parent").alias("x"), F.col("ball").alias("kx"), F.col("center").alias("cx"), F.col("radius").alias("rx"), F.col("n").alias("nx"))
        y = kids.select(F.col("parent").alias("y"), F.col("ball").alias("ky"), F.col("center").alias("cy"), F.col("radius").alias("ry"), F.col("n").alias("ny"))
        if got is None:
            got = x.select("x").distinct().withColumn("y", F.col("x"))
        both = got.select("x", "y").join(_sided(x, width), "x").join(_sided(y, width), "y").where("x <> y OR kx <= ky")
        apart, around = angle(F.col("cx"), F.col("cy")), F.col("rx") + F.col("ry")
        both = both.withColumn("least", F.when(F.col("kx") == F.col("ky"), 0.0).otherwise(apart - around - SLACK)).withColumn("most", F.when(F.col("kx") == F.col("ky"), around).otherwise(apart + around) + SLACK)
        low, high = F.least("kx", "ky"), F.greatest("kx", "ky")
        swap = F.col("kx") > F.col("ky")
        nx, ny = F.when(swap, F.col("ny")).otherwise(F.col("nx")), F.when(swap, F.col("nx")).otherwise(F.col("ny"))
        before, got = got, saved(both.where(F.col("least") <= reach).select(low.alias("x"), high.alias("y"), nx.alias("nx"), ny.alias("ny"), "least", "most"), "ball-pairs")
        if i:
            forget(before)
    return got


def blocks(members: DataFrame, leaves: DataFrame, leaf: int, columns: list[str]) -> DataFrame:
    """(ball, piece, rows): the members of each leaf as lists of structs (id, u, columns) of about `leaf` at most: larger leaves are cut by a hash."""
    size = leaves.select("ball", F.greatest(F.ceil(F.col("n") / leaf), F.lit(1)).cast("int").alias("pieces"))
    at = members.join(F.broadcast(size) if is_small(size) else size, "ball").withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    return at.groupBy("ball", "piece").agg(F.collect_list(F.struct("id", "u", *columns)).alias("rows"))


def _tiles(balls: Balls, pairs: DataFrame) -> DataFrame:
    """pairs (x, y) of leaves with a tile: leaves are put in the tree's order into groups of like numbers of members, and a tile is a pair of groups.

    A vector is copied once a tile, so no more often than there are groups: GROUPS of them, and more only where a group would be too large for a task.
    """
    total = balls.leaves.agg(F.sum("n")).first()[0] or 1
    groups = max(GROUPS, -(-total // GROUP_MEMBERS))
    order = Window.orderBy("ball").rowsBetween(Window.unboundedPreceding, -1)  # a row a leaf
    group = F.floor(F.coalesce(F.sum("n").over(order), F.lit(0)) * F.lit(groups) / F.lit(total)).cast("long")
    of = saved(balls.leaves.select("ball", group.alias("g")), "groups")
    side = lambda k: (lambda df: F.broadcast(df) if is_small(of) else df)(of.select(F.col("ball").alias(k), F.col("g").alias(f"g{k}")))
    tile = F.least("gx", "gy") * F.lit(groups + 1) + F.greatest("gx", "gy")
    return pairs.select("x", "y").join(side("x"), "x").join(side("y"), "y").select(tile.alias("tile"), "x", "y")


def compared(balls: Balls, pairs: DataFrame, members: DataFrame, leaf: int, columns: list[str], schema: str, f: Callable) -> DataFrame:
    """f's record batches for each pair of blocks of the leaves in pairs (x, y, nx, ny).

    f takes (ids, units, columns' values) of both sides, and whether they are one block. members: id, u, ball and columns. Blocks are broadcast if all of them are
    small; otherwise a task gets the pairs of a tile (_tiles) and each of its blocks once.
    """
    ship(members.sparkSession)
    packed = saved(blocks(members, balls.leaves, leaf, columns), "blocks")
    width = balls.width

    def side_of(rows):
        u = rows.field("u").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        return rows.field("id").to_numpy(zero_copy_only=False), u, {c: rows.field(c) for c in columns}

    if _small(balls.leaves.agg(F.sum("n")).first()[0] or 0, width):
        work = pairs.agg(F.sum(F.col("nx").cast("double") * F.col("ny"))).first()[0] or 0.0
        side = lambda k: F.broadcast(packed.select(F.col("ball").alias(k), F.col("piece").alias(f"p{k}"), F.col("rows").alias(f"r{k}")))
        parts = int(min(10_000, max(1, work // WORK + 1)))
        spread = pairs.select("x", "y").repartition(max(parts, members.sparkSession.sparkContext.defaultParallelism), F.xxhash64("x", "y"))
        both = spread.join(side("x"), "x").join(side("y"), "y").where("x <> y OR px <= py")
        both = both.select("rx", "ry", ((F.col("x") == F.col("y")) & (F.col("px") == F.col("py"))).alias("same"))

        def compare(batches):
            for b in batches:
                for i in range(b.num_rows):
                    x, y = (side_of(b.column(c).slice(i, 1).flatten()) for c in ("rx", "ry"))
                    yield from f(x, y, b.column("same")[i].as_py())

        out = both.mapInArrow(compare, schema)
        out._blocks = packed
        return out

    tiles = saved(_tiles(balls, pairs), "tiles")
    wanted = tiles.select("tile", F.explode(F.array("x", "y")).alias("ball")).distinct()
    # The blocks of a tile come before its pairs.
    first = wanted.join(packed, "ball").select("tile", F.lit(0).alias("kind"), F.col("ball").alias("x"), F.col("piece").cast("long").alias("y"), "rows")
    both = first.unionByName(tiles.select("tile", F.lit(1).alias("kind"), "x", "y"), allowMissingColumns=True)
    parts = max(tiles.select("tile").distinct().count(), 1)
    both = both.repartition(min(parts, 10_000), "tile").sortWithinPartitions("tile", "kind")

    def compare_tiles(batches):
        tile, held = None, {}
        for b in batches:
            of, kind, x, y = (b.column(c).to_pylist() for c in ("tile", "kind", "x", "y"))
            for i in range(b.num_rows):
                if of[i] != tile:
                    tile, held = of[i], {}
                if kind[i] == 0:
                    held.setdefault(x[i], []).append((y[i], side_of(b.column("rows").slice(i, 1).flatten())))
                    continue
                for p, one in held[x[i]]:
                    for q, other in held[y[i]]:
                        if x[i] != y[i] or p <= q:
                            yield from f(one, other, x[i] == y[i] and p == q)

    out = both.mapInArrow(compare_tiles, schema)
    out._blocks = packed
    return out


def hits(x: np.ndarray, y: np.ndarray, eps: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Cosine distances of all rows of x to all of y, and which are at most eps; a block with itself has each pair once, and none of a row with itself."""
    distance = 1.0 - x @ y.T
    near = distance <= eps
    return distance, np.triu(near, 1) if same else near


def batch(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], list(columns))
