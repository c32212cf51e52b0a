"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

Two lines are near copies if one edit (a character inserted, deleted or replaced) at most makes one the
other. All variants of a line with one character deleted are emitted as hashed keys; equal variants join,
their edit distance is verified, and the earliest line stays.

Emitting every variant of every whole line would cost its length squared, so an exact sieve comes first. One
edit leaves all but one block of a line as it was: lines are cut in blocks, and only blocks whose
surroundings (hashed) another line shares go on, first large blocks, then small ones. Variants are then
made of the small blocks that are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.llm.common import column, free_name, most_counted, saved, sized, table, tidy

#: Shorter lines, without the white space around them, take no part in one-edit matches.
LEAST_CHARS = 20
#: Lines that are so often there, at most this many of them, are looked up at their places instead of joined by shuffle.
HOT_TIMES, HOT_LINES = 100, 100_000
LARGE, SMALL = 256, 16
#: Suffix lengths are whole multiples of this, so that lines whose lengths differ by one mostly share them.
STEP = 8


def _blocks(text: Column, size: int) -> Column:
    """array<struct<a, b>>: each block of text starts after a characters and ends before the last b.

    For a pair one edit apart, m being the shorter length, some block of m takes the edit: the first a and
    the last b characters are the same in both. So a line gives the blocks of its own length and of that less one.
    """

    def of(m: Column) -> Column:
        # Two halves (rounded up to STEP) for lines of up to two blocks, else blocks of `size`.
        c = F.when(m <= 2 * size, F.lit(STEP) * F.ceil(m / (2 * STEP))).otherwise(F.lit(size)).cast("int")
        last = F.greatest(F.ceil(m / c).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda j: F.struct((j * c).alias("a"), (F.lit(STEP) * F.floor(F.greatest(m - (j + 1) * c, F.lit(0)) / STEP)).cast("int").alias("b")))

    n = F.length(text)
    return F.array_union(of(n), of(F.greatest(n - 1, F.lit(1))))


def _surroundings(text: Column, n: Column) -> Column:
    """array<struct<gate, a, b>>: the large blocks of _blocks(), gate a hash of what surrounds each.

    Lines of over two blocks are cut in chunks once from their start and once from the suffix after the first
    block, which ends where every later suffix does. A block's surroundings are running XORs over the
    hashes of numbered chunks, so that the text is read a fixed number of times, however long it is.
    """
    block = lambda a, b, left, right: F.struct(F.xxhash64(a, b, left, right).alias("gate"), a.cast("int").alias("a"), b.cast("int").alias("b"))

    def halves(m: Column) -> Column:
        c = (F.lit(STEP) * F.ceil(m / (2 * STEP))).cast("int")
        b = (F.lit(STEP) * F.floor(F.greatest(m - c, F.lit(0)) / STEP)).cast("int")
        one = block(F.lit(0), b, F.lit(0).cast("long"), F.xxhash64(F.substring(text, n - b + 1, b)))
        two = block(c, F.lit(0), F.xxhash64(F.substring(text, F.lit(1), c)), F.lit(0).cast("long"))
        return F.when(m > c, F.array(one, two)).otherwise(F.array(one))

    def running(part: Column) -> Column:
        # XORs of the first 0, 1, ... chunks of part.
        hashes = F.transform(F.regexp_extract_all(part, F.lit(f"(?s).{{1,{LARGE}}}"), F.lit(0)), lambda x, i: F.xxhash64(i, x))
        return F.aggregate(hashes, F.array(F.lit(0).cast("long")), lambda acc, h: F.concat(acc, F.array(F.element_at(acc, -1).bitwiseXOR(h))))

    def chunks(m: Column) -> Column:
        last = F.ceil(m / LARGE).cast("int") - 1
        b = lambda j: (F.lit(STEP) * F.floor(F.greatest(m - (j + 1) * LARGE, F.lit(0)) / STEP)).cast("int")
        both = F.struct(running(text).alias("p"), running(F.substring(text, n - b(F.lit(0)) + 1, b(F.lit(0)))).alias("q"))
        # A one-element array binds both, so that they are worked out once a line. The last suffix is empty, or shorter than STEP left out.
        of = lambda x: F.transform(F.sequence(F.lit(0), last), lambda j: block(j * LARGE, b(j), F.get(x["p"], j), F.when(b(j) > 0, F.element_at(x["q"], -1).bitwiseXOR(F.get(x["q"], j))).otherwise(F.lit(0).cast("long"))))
        return F.flatten(F.transform(F.array(both), of))

    of = lambda m: F.when(m <= 2 * LARGE, halves(m)).otherwise(chunks(m))
    less = F.greatest(n - 1, F.lit(1))
    # Blocks depend on these alone; seven lengths of eight have those of the length before.
    kind = lambda m: F.struct(m <= 2 * LARGE, F.floor(m / STEP), F.ceil(m / (2 * STEP)), F.ceil(m / LARGE))
    return F.when(kind(n) == kind(less), of(n)).otherwise(F.concat(of(n), of(less)))


def _cut(rows: DataFrame, keep: list[str], size: int) -> DataFrame:
    """rows (keep, gate, text) to a row for each block: gate hashes what surrounds the block, text is the block."""
    one = rows.select(*keep, "gate", "text", F.explode(_blocks(F.col("text"), size)).alias("at"))
    n = F.length("text")
    around = F.xxhash64("gate", "at.a", "at.b", F.substring("text", F.lit(1), F.col("at.a")), F.substring("text", n - F.col("at.b") + 1, F.col("at.b")))
    return one.select(*keep, around.alias("gate"), F.substring("text", F.col("at.a") + 1, n - F.col("at.a") - F.col("at.b")).alias("text"))


def _shared(blocks: DataFrame) -> DataFrame:
    """Gates that two different lines share."""
    return blocks.groupBy("gate").agg(F.min("k").alias("low"), F.max("k").alias("high")).where("low <> high").select("gate")


def dropped(docs: DataFrame, least: int = LEAST_CHARS, id_col: str = "doc_id", text_col: str = "text", exact: int | None = None) -> DataFrame:
    """(id, row, lines): for each document, by its id and the hash of id and text, the numbers (from 0) of lines to drop.

    A line goes if an earlier one, by ascending id (nulls last) and then line number, is equal or one edit
    away, white space around both left out. Whether the earlier one goes too doesn't matter. One-edit matches
    are of lines of at least `least` characters, equal ones of at least `exact` (`least` if None; 1: all that
    aren't blank). Equal rows of docs are one document.
    """
    exact = least if exact is None else min(least, max(1, exact))
    text, ident = column(text_col), column(id_col)
    row = F.xxhash64(ident, text)
    pos = F.struct(F.when(F.col("id").isNull(), 1).otherwise(0).alias("last"), F.col("id"), F.col("row"), F.col("line"))
    # Each text is hashed once, before its lines part.
    lines = docs.where(text.isNotNull()).select(ident.cast("long").alias("id"), row.alias("row"), F.split(text, "\n").alias("lines"))
    lines = lines.select("id", "row", F.posexplode("lines").alias("line", "raw"))
    lines = lines.withColumn("text_", F.btrim("raw", F.lit(" \t\n\x0b\x0c\r"))).where(F.length("text_") >= exact)
    lines = lines.select(pos.alias("pos"), F.xxhash64("text_").alias("k"), F.xxhash64(F.lit(1), F.col("text_")).alias("k2"), F.col("text_").alias("text"))

    lines = lines.withColumn("n", F.length("text"))
    # Lines too short for one-edit matches have no blocks: only equal ones meet.
    at = _surroundings(F.col("text"), F.col("n"))
    at = at if exact == least else F.when(F.col("n") >= least, at)

    # Pass one has gates and hashes only; lines of shared gates are cut again, with their texts.
    places = saved(lines.select("k", "k2", "pos", F.array_distinct(at.getField("gate")).alias("gates")), "lines")
    # Equal lines: of each the first place, and how many there are.
    first = places.groupBy("k", "k2").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("times")).select("k", "k2", "first", (F.col("first") < F.col("last")).alias("many"), "times")
    gates = places.select(F.explode("gates").alias("gate"), "k")
    shared = saved(_shared(gates), "shared")
    again = sized(saved(gates.join(sized(shared), "gate", "left_semi").select("k").distinct(), "again"))
    tidy(docs.sparkSession)
    large = lines.join(again, "k", "left_semi").select("k", "k2", "text", "n", F.explode(at).alias("at"))
    large = large.select("k", "k2", "at.gate", F.substring("text", F.col("at.a") + 1, F.col("n") - F.col("at.a") - F.col("at.b")).alias("text"))
    kept = saved(large.join(sized(shared), "gate", "left_semi").dropDuplicates(["gate", "k", "k2"]), "blocks")
    # Until here a gate was shared by large blocks; now by small ones within them.
    small = saved(_cut(kept, ["k", "k2"], SMALL), "small")
    tidy(docs.sparkSession)
    small = small.join(sized(_shared(small)), "gate", "left_semi").dropDuplicates(["gate", "k", "k2", "text"])

    # Variants: a replaced character leaves the same rest at the same place; an inserted one leaves the shorter line.
    n = F.length("text")
    less = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(F.col("text"), F.lit(1), i - 1), F.substring(F.col("text"), i + 1, n)))
    variants = F.flatten(
        F.array(
            F.transform(less, lambda s, i: F.struct(F.xxhash64(F.col("gate"), i, n, s).alias("v"), F.lit(False).alias("whole"), F.lit(True).alias("replace"))),
            F.transform(less, lambda s: F.struct(F.xxhash64(F.col("gate"), s).alias("v"), F.lit(False).alias("whole"), F.lit(False).alias("replace"))),
            F.array(F.struct(F.xxhash64("gate", "text").alias("v"), F.lit(True).alias("whole"), F.lit(False).alias("replace"))),
        )
    )
    v = small.select("k", "k2", "gate", "text", F.explode(F.array_distinct(variants)).alias("x")).select("k", "k2", "gate", "text", "x.*")
    useful = v.groupBy("v", "replace").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.max("whole").alias("whole")).where("low <> high AND (replace OR whole)").select("v", "replace")
    v = saved(v.join(sized(useful), ["v", "replace"], "left_semi").join(first, ["k", "k2"]).withColumn("p", F.struct("first", "text", "k", "k2", "gate")), "variants")
    # Each joins only the earliest of its kind: replaced ones the earliest with the same rest, longer lines the shorter one and the other way round.
    heads = v.groupBy("v", "replace", "whole").agg(F.min("p").alias("head"))
    heads = heads.select("v", "replace", F.when(F.col("replace"), F.col("whole")).otherwise(~F.col("whole")).alias("whole"), "head")
    near = v.join(heads, ["v", "replace", "whole"]).where("head.first < first AND head.gate = gate")
    near = near.where(F.levenshtein(F.col("text"), F.col("head.text"), 1) == 1).select("k", "k2").distinct()

    go = first.join(near.withColumn("near", F.lit(True)), ["k", "k2"], "left").where("many OR near").select("k", "k2", "first", F.coalesce("near", F.lit(False)).alias("near"), "times")
    # The most frequent lines, a bounded number, are sent to all places; only the others meet their places by shuffle, so that no line brings all its places to one task.
    go = saved(go, "go")
    tidy(docs.sparkSession)
    hot = F.broadcast(most_counted(go.where(F.col("times") >= HOT_TIMES), "times", HOT_LINES).select("k", "k2", "first", "near"))
    at = places.select("k", "k2", "pos")
    cold = at.join(hot.select("k", "k2"), ["k", "k2"], "left_anti").join(go.drop("times"), ["k", "k2"])
    gone = at.join(hot, ["k", "k2"]).unionByName(cold).where("near OR pos > first")
    return gone.groupBy(F.col("pos.id").alias("id"), F.col("pos.row").alias("row")).agg(F.collect_set(F.col("pos.line")).alias("lines"))


def deduped(docs: DataFrame, least: int = LEAST_CHARS, id_col: str = "doc_id", text_col: str = "text", exact: int | None = None) -> DataFrame:
    """docs without the lines that dropped() names, and with the columns __lines (before) and __dropped.

    Null and empty texts stay as they are; an empty table gives no rows. Other columns of docs are kept, whatever
    their names: if docs has one of ours, ours gets an underscore more.
    """
    names = {n: free_name(docs, n) for n in ("__lines", "__dropped", "__id", "__row", "__gone")}
    total, lost, ident, row, gone_n = names.values()
    gone = dropped(docs, least, id_col, text_col, exact).toDF(ident, row, gone_n)
    same = column(id_col).cast("long").eqNullSafe(F.col(ident)) & (F.xxhash64(column(id_col), column(text_col)) == F.col(row))
    out = docs.join(gone, same, "left")
    lines = F.split(column(text_col), "\n")
    rest = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone_n))
    text = F.when(F.col(gone_n).isNull(), column(text_col)).otherwise(F.array_join(F.transform(rest, lambda i: F.get(lines, i)), "\n"))
    out = out.withColumn(total, F.coalesce(F.when(column(text_col).isNull(), 0).otherwise(F.size(lines)), F.lit(0)).cast("long"))
    out = out.withColumn(lost, F.coalesce(F.size(gone_n), F.lit(0)).cast("long")).withColumn(text_col, text)
    return out.drop(ident, row, gone_n)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its text without dropped lines, and how many lines it had and lost."""
    out = deduped(table(spark, sf_dir, "documents").select("doc_id", "text"), exact=1)
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), "text")
