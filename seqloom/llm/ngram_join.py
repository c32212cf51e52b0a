"""N-gram Jaccard join by vertical partitioning.

All n-grams have one global order: those found in few documents first, frequent ones last, and by hash
within that. The order is cut into fragments. Documents whose first n-grams (the prefix, which any
pair above the threshold must share in part) meet become candidates; the overlap of a candidate pair is
counted in every fragment apart, from the two documents' segments there, and summed per pair.

A group of documents that share a prefix n-gram (and a class of sizes) never becomes all its pairs. In two rounds each
member is compared with one of the group's, its first in an order by hashes. Members that this links need
no more. Those still outside their group's largest component are compared with the others of the group, each pair in one
of the groups that it shares, if counts of n-grams by fine fragments leave a link possible. No link is lost.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.llm.common import column, components, forget, free_name, most_counted, saved, sized, table, tidy
from seqloom.llm.shingles import mixed, shingle_sets

#: Fragments of the global order: of n-grams outside the list of frequent ones, by hash, and of those in it, from these magnitudes on.
RARE_FRAGMENTS, MAGNITUDES = 4, (1, 3, 6, 10)
#: Keys of a member that are compared to find the one group in which a pair is made.
SKETCH = 8
#: Rounds in which members of a group are compared with its first one: whether members with few n-grams of their own come first (the text that near copies
#: were made from), and in how many orders by keys, so that copies that share many keys meet several members.
ORDERS = ((True, 8), (False, 1 << 40))
#: Entries of the list of frequent n-grams sent to all tasks: a fixed bound. The list only orders n-grams; results don't depend on it.
FREQUENT = 500_000
#: n-grams that a task counts before it passes on those that it found COUNTED times or more.
CHUNK = 4_000_000
COUNTED = 3


def _frequent(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and magnitudes of the most frequent n-grams, by documents; counted over all documents."""

    def count(batches):
        held, n = [], 0
        for b in batches:
            for s in shingle_sets(b["text"], width):
                held.append(s)
                n += len(s)
                if n >= CHUNK:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)

    def flush(held):
        h, c = np.unique(np.concatenate(held), return_counts=True)
        return pd.DataFrame({"h": h[c >= COUNTED].view(np.int64), "c": c[c >= COUNTED]})

    counts = saved(docs.mapInPandas(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "counts")
    top = most_counted(counts, "c", FREQUENT).toPandas()
    forget(counts)
    h, c = top["h"].to_numpy(dtype=np.int64).view(np.uint64), top["c"].to_numpy(dtype=np.float64)
    by = np.argsort(h)
    return h[by], np.ceil(np.log2(np.maximum(c[by], 1))).astype(np.uint64)


def _ranks(s: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Magnitudes of hashes: 0 outside the list of frequent ones."""
    known, size = frequent
    if not len(known):
        return np.zeros(len(s), dtype=np.uint64)
    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
    return np.where(known[at] == s, size[at], np.uint64(0))


def _prefixes(docs: DataFrame, shared, width: int, num: int, den: int) -> DataFrame:
    """shared: _frequent(), broadcast. (id, n, sid, prefix, counts): size, a 128-bit hash of the set, the prefix, and the n-grams in each of 2**k equal fragments."""
    def scan(batches):
        for b in batches:
            out = []
            for s in shingle_sets(b["text"], width):
                n = len(s)
                if not n:
                    out.append((0, None, None, None))
                    continue
                rank = _ranks(s, shared.value)
                keep = n - -(-num * n // den) + 1
                # Ascending by (magnitude, hash): s is ascending by hash and the sort is stable.
                prefix = s[np.argsort(rank, kind="stable")[:keep]]
                sid = np.array([mixed(s).sum(), mixed(s ^ np.uint64(0x5BD1E995)).sum()], dtype=np.uint64).tobytes()
                bits = max(3, (n - 1).bit_length() - 2)
                counts = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
                out.append((n, sid, prefix.view(np.int64), counts.astype(np.int32)))
            n, sid, prefix, counts = zip(*out, strict=True) if out else ((), (), (), ())
            yield pd.DataFrame({"id": b["id"], "n": n, "sid": sid, "prefix": prefix, "counts": counts})

    return docs.mapInPandas(scan, "id long, n long, sid binary, prefix array<long>, counts array<int>")


def _segments(docs: DataFrame, ids: DataFrame, shared, width: int) -> DataFrame:
    """(id, n, segments) of the documents listed in ids: their sets, cut at the same places of the global order."""
    few = docs.join(sized(ids), "id", "left_semi")

    def cut(batches):
        for b in batches:
            rows = []
            for i, s in zip(b["id"], shingle_sets(b["text"], width), strict=True):
                part = np.searchsorted(MAGNITUDES, _ranks(s, shared.value).astype(np.int64), side="right") + RARE_FRAGMENTS - 1
                part = np.where(part < RARE_FRAGMENTS, (((s >> np.uint64(32)) * np.uint64(RARE_FRAGMENTS)) >> np.uint64(32)).astype(np.int64), part)
                rows.append((i, len(s), [s[part == f].view(np.int64) for f in range(RARE_FRAGMENTS + len(MAGNITUDES))]))
            yield pd.DataFrame(rows, columns=["id", "n", "segments"])

    return few.mapInPandas(cut, "id long, n long, segments array<array<long>>").dropDuplicates(["id"])


def _overlaps(docs: DataFrame, pairs: DataFrame, shared, width: int) -> DataFrame:
    """pairs (x, y) with nx, ny and overlap: partial overlaps of each fragment, summed."""
    segments = saved(_segments(docs, pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct(), shared, width), "segments")
    y = segments.select(F.col("id").alias("y"), F.col("n").alias("ny"), F.col("segments").alias("sy"))
    x = segments.select(F.col("id").alias("x"), F.col("n").alias("nx"), F.col("segments").alias("sx"))
    parts = F.zip_with("sx", "sy", lambda a, b: F.size(F.array_intersect(a, b)).cast("long"))
    both = pairs.join(y, "y").join(x, "x")
    out = saved(both.select("x", "y", "nx", "ny", F.aggregate(parts, F.lit(0).cast("long"), lambda s, t: s + t).alias("overlap")), "overlaps")
    forget(segments)
    return out


def _possible(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """pairs (x, y) with n (the size of y) and near: whether their sizes, and the least n-grams that both have in each fine fragment, allow a link."""
    y = sets.select(F.col("rep").alias("y"), F.col("n").alias("n"), F.col("counts").alias("b"))
    both = pairs.join(y, "y").join(y.toDF("x", "m", "a"), "x")
    # Sets near in size have as many fragments, or twice as many: then pairs of these make one.
    half = lambda c: F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(c) / 2).cast("int") - 1, F.lit(0))), lambda i: F.get(c, 2 * i) + F.get(c, 2 * i + 1))
    a, b = F.col("a"), F.col("b")
    a, b = F.when(F.size(a) > F.size(b), half(a)).otherwise(a), F.when(F.size(b) > F.size(a), half(b)).otherwise(b)
    most = F.aggregate(F.zip_with(a, b, lambda s, t: F.coalesce(F.least(s, t), s, t)), F.lit(0), lambda s, t: s + t)
    sizes = F.least("n", "m") * den >= F.greatest("n", "m") * num
    near = F.when(sizes, most * den >= (F.col("n") + F.col("m") - most) * num).otherwise(F.lit(False))
    return both.select("x", "y", "n", near.alias("near"))


def _open(members: DataFrame) -> DataFrame:
    """Rows of the groups (key, class) whose members are in more than one component c."""
    several = members.groupBy("key", "class").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high")
    return members.join(several.select("key", "class"), ["key", "class"], "left_semi")


def classes(docs: DataFrame, width: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the columns n_shingles and component_id.

    Ids name one text: only whole rows may repeat. n_shingles is the size of the document's set of distinct width-word shingles (A-Z lower-cased; fewer
    words: the whole sequence as one). Documents link when den * overlap >= num * union; component_id is
    the smallest id reachable by links. Empty and null texts have size 0, link with nothing and are their
    own component. Rows of a null id get the smallest id of their set, or null. Repeated rows are one set. Clashing column names of docs stay,
    ours get an underscore. Shingles are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    pure = docs.select(column(id_col).cast("long").alias("id"), column(text_col).alias("text"))
    shared = spark.sparkContext.broadcast(_frequent(pure, width))
    p = saved(_prefixes(pure, shared, width, num, den), "prefixes")
    sets = saved(p.where("n > 0").groupBy("sid").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.min_by(F.struct("prefix", "counts"), "id").alias("s")).select("sid", "rep", "n", "s.prefix", "s.counts").where("rep IS NOT NULL"), "sets")

    whole, p = p, saved(p.select("id", "n", "sid"), "sizes")
    forget(whole)

    keys = sets.select(F.col("rep").alias("y"), "n", F.explode("prefix").alias("key"))
    by = Window.partitionBy("key").orderBy("y")
    met = keys.withColumn("other", F.coalesce(F.lag("y").over(by), F.lead("y").over(by))).where("other IS NOT NULL")
    # Linked sizes are at most a factor of den / num apart: the classes of a pair's sizes are equal or neighbours. Members are guests in the class above their own.
    size_class = F.floor(F.log(F.col("n")) / (math.log(den / num) * (1 + 1e-9))).cast("int")
    own = F.struct(size_class.alias("class"), F.lit(True).alias("own"))
    guest = F.struct((size_class + 1).alias("class"), F.lit(False).alias("own"))
    members = saved(met.select("key", "y", F.explode(F.array(own, guest)).alias("at")).select("key", "y", "at.class", "at.own"), "members")
    linked = F.col("overlap") * den >= (F.col("nx") + F.col("ny") - F.col("overlap")) * num
    # Of each member: how many of its n-grams others may have, and a sketch of its keys.
    others = members.where("own").groupBy("y").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    facts = sets.withColumnRenamed("rep", "y").join(others, "y")
    facts = facts.select("y", "n", (F.col("n") - F.size("prefix") + F.size("keys")).alias("common"), F.slice("keys", 1, SKETCH).alias("sketch"))
    facts = saved(facts, "facts")
    tidy(spark)
    nodes = lambda comp: facts.select("y", (F.col("n") - F.col("common")).alias("rare")).join(comp.toDF("y", "c"), "y", "left").withColumn("c", F.coalesce("c", "y"))
    where = lambda df, comp: df.select("key", "class", "y", "own").join(nodes(comp), "y")

    def opened(members: DataFrame, comp: DataFrame) -> DataFrame:
        # Both sides of _open() read the members' components: they are looked up once.
        placed = saved(where(members, comp), "placed")
        forget(members)
        out = saved(_open(placed), "open")
        forget(placed)
        return out

    comp = members.select(F.col("y").alias("node"), F.col("y").alias("component")).limit(0)
    tried = []
    for common_first, orders in ORDERS:
        # Only groups of more than one component; their members are compared with the first one, if that is in another.
        open_ = opened(members, comp)
        # Components only grow: groups that aren't open any more stay so.
        members = open_
        order = [*(["rare"] if common_first else []), F.xxhash64("y", F.pmod("key", F.lit(orders))), "y"]
        group = Window.partitionBy("key", "class").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        stars = open_.withColumn("first", F.first(F.struct("y", "c")).over(group)).select("y", "c", F.col("first.y").alias("x"), F.col("first.c").alias("cx"))
        pairs = stars.where("c <> cx").select("x", "y").distinct()
        pairs = saved(_possible(pairs, sets, num, den), "pairs")
        tried.append(pairs.select("x", "y"))
        tidy(spark)
        found = _overlaps(pure, pairs.where("near").select("x", "y"), shared, width)
        links = found.where(linked).select(F.col("x").alias("a"), F.col("y").alias("b"))
        comp = saved(components(links.union(comp)), "components")  # a component's stars stand for its links
        tidy(spark)

    # What is left: members outside their group's largest component, with all others of the group that are in another.
    rest = opened(members, comp)
    largest = rest.groupBy("key", "class", "c").count().groupBy("key", "class").agg(F.max(F.struct("count", "c"))["c"].alias("largest"))
    # A pair is made in one group: that of the least key that both sketches have. Pairs whose sketches share none are made in each group that both are in.
    whole = rest
    rest = saved(rest.join(largest, ["key", "class"]).join(facts, "y").select("key", "class", "y", "own", "n", "common", "c", "sketch", (F.col("c") != F.col("largest")).alias("out")), "rest")
    forget(whole)
    tidy(spark)
    a = rest.where("out").select("key", "class", *[F.col(x).alias(f"{x}_a") for x in ("y", "own", "n", "common", "c", "sketch")])
    b = rest.select("key", "class", *[F.col(x).alias(f"{x}_b") for x in ("y", "own", "n", "common", "c", "out", "sketch")])
    one = (F.col("c_a") != F.col("c_b")) & (~F.col("out_b") | (F.col("y_a") < F.col("y_b"))) & (F.col("own_a") | F.col("own_b"))
    # Only n-grams that others have can overlap.
    most = F.least("common_a", "common_b")
    one &= most * den >= (F.col("n_a") + F.col("n_b") - most) * num
    one &= F.coalesce(F.get(F.array_intersect("sketch_a", "sketch_b"), F.lit(0)), F.col("key")) == F.col("key")
    more = a.join(b, ["key", "class"]).where(one).select(F.least("y_a", "y_b").alias("x"), F.greatest("y_a", "y_b").alias("y")).distinct()
    before = functools.reduce(DataFrame.union, tried).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    untried = saved(more.join(before, ["x", "y"], "left_anti"), "untried")
    forget(rest)
    tidy(spark)
    more = saved(_possible(untried, sets, num, den).where("near").select("x", "y"), "more")
    forget(untried)
    tidy(spark)
    if not more.isEmpty():
        again = _overlaps(pure, more, shared, width).where(linked)
        comp = saved(components(again.select(F.col("x").alias("a"), F.col("y").alias("b")).union(comp)), "components")
    shared.destroy()
    tidy(spark)

    ids = sets.select("sid", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("sid", F.coalesce("component", "rep").alias("component"))
    n_name, c_name = free_name(docs, "n_shingles"), free_name(docs, "component_id")
    result = p.select("id", "n", "sid").join(ids, "sid", "left")
    result = result.select("id", F.col("n").alias(n_name), F.coalesce("component", "id").alias(c_name))
    return result


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and component; see classes for nulls, ties, repeated rows and empty tables."""
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")
