"""Range and similarity joins, density clustering and the cluster-level split."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators import balls
from seqloom.operators.balls import dot
from seqloom.storage import forget, is_small, saved

CONTACT_RADIUS = 8.0


#: Pairs of points that one task compares in a cube, about; slabs that a cube with more is cut into, at most, before slabs are cut by a hash.
PAIRS, SLABS = 4_000_000, 64

#: A cube itself and one of each two neighbours that face each other over it: two cubes meet once.
AHEAD = [(x, y, z) for x in (0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) >= (0, 0, 0)]


def visits(points: DataFrame, radius: float, group: str, index: str, most: int = PAIRS) -> tuple[DataFrame, DataFrame, list[str]]:
    """Visitors (with own: whether in their own cube), the points they visit, and the columns on which they meet; see range_pairs."""
    p = points.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in "xyz")).select(F.col(group).alias("g"), F.col(index).alias("i"), "x", "y", "z")
    cube = ["g", "cx", "cy", "cz"]
    cell = [F.floor(F.col(c) / radius).alias(f"c{c}") for c in "xyz"]
    ahead = F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip("xyz", d, strict=True)]) for d in AHEAD]))

    def visiting(df: DataFrame) -> DataFrame:
        df = df.withColumn("d", ahead).withColumn("own", (F.col("d.x") == 0) & (F.col("d.y") == 0) & (F.col("d.z") == 0))
        return df.withColumns({f"c{c}": F.col(f"c{c}") + F.col(f"d.{c}") for c in "xyz"}).drop("d")

    left = visiting(p.select("g", *[F.col(c).alias(f"a{c}") for c in "ixyz"], *cell))
    right = p.select("g", *[F.col(c).alias(f"b{c}") for c in "ixyz"], *cell)
    # Cubes with much work, from counts of cubes and their visitors.
    homes = right.groupBy(*cube).agg(F.count("*").alias("n"))
    hot = homes.join(visiting(homes.withColumnRenamed("n", "v")).groupBy(*cube).agg(F.sum("v").alias("v")), cube)
    work = F.ceil(F.col("n").cast("double") * F.col("v") / most)
    slabs = F.least(work, F.lit(SLABS)).cast("int").alias("slabs")
    hot = saved(hot.where(work > 1).select(*cube, slabs, F.greatest(F.ceil(work / SLABS), F.lit(1)).cast("int").alias("times")), "hot")
    if hot.isEmpty():
        return left, right, cube
    side = lambda df: F.broadcast(df) if is_small(df) else df
    # Where slabs begin, the first at the least x, and how often each is cut by a hash. A cube has no more slabs than its work asks for.
    quantiles = [i / SLABS for i in range(1, SLABS)]
    cuts = right.join(side(hot), cube).groupBy(*cube, "slabs", "times").agg(F.percentile_approx("bx", quantiles, 1_000).alias("all"))
    at = lambda i: F.get("all", F.floor(i * SLABS / F.col("slabs")).cast("int") - 1)
    cuts = saved(cuts.select(*cube, "times", F.transform(F.sequence(F.lit(1), F.col("slabs") - 1), at).alias("cuts")), "cuts")
    begins, none = F.concat(F.array(F.lit(float("-inf"))), "cuts"), F.col("cuts").isNull()
    right = right.join(side(cuts), cube, "left")
    slab = F.when(none, 0).otherwise(F.size(F.filter("cuts", lambda c: c <= F.col("bx"))))
    right = right.withColumn("slab", slab.cast("int")).withColumn("piece", F.when(none, 0).otherwise(F.pmod(F.xxhash64("bi"), F.col("times"))).cast("int")).drop("cuts", "times")
    left = left.join(side(cuts), cube, "left")
    reaches = lambda i: (F.get(begins, i) <= F.col("ax") + radius) & (F.coalesce(F.get(begins, i + 1), F.lit(float("inf"))) >= F.col("ax") - radius)
    reached = F.filter(F.sequence(F.lit(0), F.size("cuts")), reaches)
    left = left.withColumn("slab", F.explode(F.when(none, F.array(F.lit(0))).otherwise(reached)))
    left = left.withColumn("piece", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("times"), F.lit(1)) - 1))).drop("cuts", "times")
    return left, right, [*cube, "slab", "piece"]


def range_pairs(points: DataFrame, radius: float = CONTACT_RADIUS, group: str = "structure_id", index: str = "index", most: int = PAIRS) -> DataFrame:
    """(group, idx1, idx2): pairs idx1 < idx2 of a group at most radius apart (points: group, index, x, y, z).

    Points are put in cubes of the radius' size; a point meets those of its own and of 13 of the 26 neighbouring cubes, those of the others meet it, so
    the join is on equal cubes and no pair of far points is made. Cubes in which more than `most` pairs would meet are cut
    by quantiles of x (a bounded sketch) into slabs of like counts, as many as that takes, and a point visits only slabs that its radius reaches. NULL and NaN coordinates take no part.
    """
    left, right, keys = visits(points, radius, group, index, most)
    square = sum(((F.col(f"a{c}") - F.col(f"b{c}")) * (F.col(f"a{c}") - F.col(f"b{c}")) for c in "xyz"), F.lit(0.0))
    once = F.when(F.col("own"), F.col("ai") < F.col("bi")).otherwise(F.col("ai") != F.col("bi"))
    pairs = left.join(right, keys).where(once & (square <= radius * radius))
    return pairs.select(F.col("g").alias(group), F.least("ai", "bi").alias("idx1"), F.greatest("ai", "bi").alias("idx2"))


def units(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, u): vectors as doubles of length 1; null and zero vectors are left out."""
    v = F.col(vec_col).cast("array<double>")
    n = F.sqrt(dot(v, v))
    return vectors.where(v.isNotNull()).select(F.col(id_col).alias("id"), v.alias("v"), n.alias("n")).where("n > 0").select("id", F.transform("v", lambda x: x / F.col("n")).alias("u"))


def _reach(eps: float) -> float:
    """On unit vectors a cosine distance of eps is an angle of at most this."""
    return math.acos(max(-1.0, min(1.0, 1 - eps)))


def similarity_pairs(vectors: DataFrame, eps: float, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = balls.CHILDREN, leaf: int = balls.LEAF) -> DataFrame:
    """(a, b, distance): pairs a < b at cosine distance at most eps, exact.

    Vectors lie in a tree of balls (pivots: children of a ball); only pairs of leaves whose bounds meet are compared, by matrix products.
    A vector is copied once a leaf that its own leaf meets. Where angles are wide, in structureless vectors, that may be all.
    """
    found = balls.tree(units(vectors, id_col, vec_col), leaf, pivots)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "a long, b long, distance double")
    pairs = balls.pairs_within(found, _reach(eps))

    def listed(x, y, same):
        (i, u, _), (j, v, _) = x, y
        distance, near = balls.hits(u, v, eps, same)
        at, to = np.nonzero(near)
        p, q = i[at], j[to]
        yield balls.batch({"a": np.minimum(p, q), "b": np.maximum(p, q), "distance": distance[at, to]})

    out = saved(balls.compared(found, pairs, found.members, leaf, [], "a long, b long, distance double", listed), "pairs")
    found.forget()
    forget(pairs)
    return out


def compared_pairs(vectors: DataFrame, eps: float, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = balls.CHILDREN, leaf: int = balls.LEAF) -> int:
    """How many pairs of vectors similarity_pairs compares: those of leaves whose bounds meet."""
    found = balls.tree(units(vectors, id_col, vec_col), leaf, pivots)
    if found is None:
        return 0
    n = F.when(F.col("x") == F.col("y"), F.col("nx") * (F.col("nx") - 1) / 2).otherwise(F.col("nx") * F.col("ny"))
    return int(balls.pairs_within(found, _reach(eps)).agg(F.sum(n)).first()[0] or 0)


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root): the smallest id of each node's connected component; any 64-bit ids. Every round takes the least neighbouring root and jumps to the root's root."""
    edges = saved(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    state = saved(nodes.select("id", F.col("id").alias("root")), "roots")
    for _ in range(rounds):
        offer = edges.join(state.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("root").alias("offer"))
        step = state.join(offer.withColumnRenamed("a", "id"), "id", "left").select("id", F.col("root").alias("was"), F.least("root", F.coalesce("offer", "root")).alias("root"))
        jump = step.select(F.col("id").alias("root"), F.col("root").alias("above"))
        before, state = state, saved(step.join(jump, "root", "left").select("id", F.least("root", F.coalesce("above", "root")).alias("root"), "was"), "roots")
        changed = state.where("root <> was").isEmpty()
        forget(before)
        state = _without(state, "was")
        if changed:
            forget(edges)
            return state
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _without(df: DataFrame, column: str) -> DataFrame:
    out = df.drop(column)
    out._saved_at = df._saved_at
    return out


def _forest(near: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (unit, smallest unit of its component) of the graph whose sides a and b are joined where near is true: as many as there are units, not as hits."""
    rows, cols = near.any(axis=1), near.any(axis=0)
    near, a, b = near[np.ix_(rows, cols)], a[rows], b[cols]
    if not near.size:
        return a[:0], a[:0]
    top = np.iinfo(np.int64).max
    root_a, root_b = a.copy(), b.copy()
    while True:
        new_a = np.minimum(root_a, np.where(near, root_b[None, :], top).min(axis=1))
        new_b = np.minimum(root_b, np.where(near, new_a[:, None], top).min(axis=0))
        if np.array_equal(new_a, root_a) and np.array_equal(new_b, root_b):
            break
        root_a, root_b = new_a, new_b
    # A unit that stands in several rows has all of its roots joined through it.
    unit, root = np.concatenate((a, b)), np.concatenate((root_a, root_b))
    both = np.unique(np.stack((unit, root), axis=1), axis=0)
    return both[:, 0], both[:, 1]


def dbscan(vectors: DataFrame, eps: float = 0.5, min_samples: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", leaf: int = balls.LEAF) -> DataFrame:
    """(id, cluster): density clusters by cosine distance, named by their smallest core member; noise is -1.

    A point counts among its own neighbours. A border point joins the smallest cluster among its core neighbours. Null and zero vectors are left out.

    A ball of min_samples members or more that are all within eps of each other is dense: its members are core and of one cluster by count alone, and no pair of
    them is made. Two dense balls, and a dense ball and a leaf, whose bounds say that all pairs are near, are joined by that. Other pairs of leaves whose bounds meet are compared, once
    for the neighbours of members of leaves, and again for the links of core points, of which a pair of leaves gives no more than it has points.
    """
    if eps <= 0 or min_samples <= 0:
        raise ValueError("eps and min_samples must be positive")
    reach = _reach(eps)
    nodes = units(vectors, id_col, vec_col)
    found = balls.tree(nodes, leaf, dense_radius=reach / 2 - balls.SLACK, dense=min_samples)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "id long, cluster long")
    facts = found.leaves.select("ball", "tight", "first", "n")
    side = lambda df: F.broadcast(df) if is_small(df) else df
    kinds = lambda k: side(facts.select(F.col("ball").alias(k), F.col("tight").alias(f"t{k}"), F.col("first").alias(f"f{k}")))
    pairs = saved(balls.pairs_within(found, reach).join(kinds("x"), "x").join(kinds("y"), "y"), "pairs")
    # Pairs with a dense side all of whose points are near need no look at their points.
    full = pairs.where((F.col("most") <= reach) & (F.col("tx") | F.col("ty")) & (F.col("x") != F.col("y")))
    open_ = pairs.where(~((F.col("x") == F.col("y")) & F.col("tx")) & ~((F.col("most") <= reach) & (F.col("tx") | F.col("ty"))))
    covered = full.select(F.when(F.col("tx"), F.col("y")).otherwise(F.col("x")).alias("ball"), F.when(F.col("tx"), F.col("fx")).otherwise(F.col("fy")).alias("b"))
    covered = covered.groupBy("ball").agg(F.min("b").alias("over"))
    members = found.members.join(side(facts.select("ball", "tight", "first")), "ball").join(side(covered), "ball", "left")
    known = F.when(F.col("tight"), F.col("first")).when(F.col("over").isNotNull(), F.col("id"))
    members = saved(members.select("id", "u", "ball", "tight", "over", known.alias("unit")), "members")

    def counted(x, y, same):
        (i, u, mine), (j, v, other) = x, y
        _, near = balls.hits(u, v, eps, same)
        for ids, n, own in ((i, near.sum(axis=1), mine), (j, near.sum(axis=0), other)):
            open_points = pa_null(own["unit"]) & (n > 0)
            yield balls.batch({"id": ids[open_points], "n": n[open_points].astype(np.int64)})

    # Neighbours are counted of points that aren't core by their ball already.
    some = open_.where("NOT (tx AND ty)")
    degree = balls.compared(found, some, members, leaf, ["unit"], "id long, n long", counted)
    degree = saved(degree.groupBy("id").agg(F.sum("n").alias("n")), "degree")
    core = members.join(degree, "id", "left").withColumn("unit", F.coalesce("unit", F.when(F.coalesce("n", F.lit(0)) + 1 >= min_samples, F.col("id"))))
    core = saved(core.select("id", "u", "ball", "over", "unit"), "core")
    forget(members)

    def linked(x, y, same):
        (i, u, mine), (j, v, other) = x, y
        _, near = balls.hits(u, v, eps, same)
        out_a, out_b = pa_null(mine["unit"]), pa_null(other["unit"])
        a, b = mine["unit"].fill_null(0).to_numpy(zero_copy_only=False), other["unit"].fill_null(0).to_numpy(zero_copy_only=False)
        unit, root = _forest(near & ~out_a[:, None] & ~out_b[None, :], a, b)
        yield balls.batch({"a": unit, "b": root, "border": np.zeros(len(unit), dtype=bool)})
        # A point that isn't core has less than min_samples neighbours.
        for ids, of, hit in ((i, b, near & out_a[:, None] & ~out_b[None, :]), (j, a, (near & ~out_a[:, None] & out_b[None, :]).T)):
            p, q = np.nonzero(hit)
            yield balls.batch({"a": ids[p], "b": of[q], "border": np.ones(len(p), dtype=bool)})

    links = saved(balls.compared(found, open_, core, leaf, ["unit"], "a long, b long, border boolean", linked).distinct(), "links")
    by_ball = full.where("tx AND ty").select(F.col("fx").alias("a"), F.col("fy").alias("b")).unionByName(core.where("over IS NOT NULL").select(F.col("unit").alias("a"), F.col("over").alias("b")))
    root = components(core.where("unit IS NOT NULL").select(F.col("unit").alias("id")).distinct(), links.where("NOT border").select("a", "b").unionByName(by_ball))
    near = links.where("border").join(root.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
    out = core.select("id", "unit").join(root.select(F.col("id").alias("unit"), "root"), "unit", "left").join(near, "id", "left")
    out = saved(out.select("id", F.coalesce("root", "near", F.lit(-1)).alias("cluster")), "clusters")
    found.forget()
    for df in (pairs, degree, core, links, root):
        forget(df)
    return out


def pa_null(column) -> np.ndarray:
    """Where an Arrow column is null."""
    return column.is_null().to_numpy(zero_copy_only=False)


def cluster_split(clusters: DataFrame, test_ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """(id, cluster, split): whole clusters go to test or train, noise to neither.

    ceil(test_ratio * clusters) clusters, first by a hash of seed and name, are the test ones; a single cluster trains.
    """
    if not 0 < test_ratio < 1:
        raise ValueError("test_ratio must lie between 0 and 1")
    kept = clusters.where("cluster <> -1")
    names = kept.select("cluster").distinct()
    order = Window.orderBy(F.md5(F.concat(F.col("cluster").cast("string"), F.lit(f"|{seed}"))), "cluster")
    ranked = names.select("cluster", F.row_number().over(order).alias("r"), F.count("*").over(Window.partitionBy()).alias("k"))
    side = F.when((F.col("k") > 1) & (F.col("r") <= F.ceil(F.lit(test_ratio) * F.col("k"))), "test").otherwise("train")
    return kept.join(ranked.select("cluster", side.alias("split")), "cluster").select("id", "cluster", "split")
