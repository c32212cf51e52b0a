"""Mixing sources to target weights.

Tokens are summed per source, each source gets a repetition rate, and every document is emitted
floor(rate) times plus once more with probability rate - floor(rate), by a hash of the seed and its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.llm.common import WORD, column, free_name, sized, table

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target) from sizes (source, size).

    The target is min(most * source_size, level * weight), with the one level at which targets sum to
    all sizes: this is where resharing the excess by weight ends. Sources are dealt their weights in
    code point order, a null source last. A null size counts as 0; no rows give no rows.
    """
    s = sizes.groupBy("source").agg(F.sum(F.coalesce("size", F.lit(0))).cast("long").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.select("*", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")).cast("double").alias("w"))
    s = s.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    full = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    rest = full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    earlier = full.rowsBetween(Window.unboundedPreceding, -1)
    whole = F.sum("source_size").over(Window.partitionBy())
    level = (whole - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / F.sum("w").over(rest)
    s = s.withColumn("level", level).withColumn("open", F.col("level") <= F.col("cap") / F.col("w"))
    # Levels fall from the first source that its cap does not stop; all others share at that source's.
    s = s.withColumn("level", F.max(F.when(F.col("open"), F.col("level"))).over(Window.partitionBy()))
    return s.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), "cap")).alias("target"))


def with_copies(docs: DataFrame, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs and the columns size, source_size, target and copies (how often the mix takes the row).

    Equal rows draw alike, so reruns agree. A null text has size 0, a null id draws as the word null,
    a null source is a source of its own. Columns of docs with clashing names stay; ours get a leading
    underscore then. Only (source, size) is shuffled, summed before it is sent. Draws are independent, so a source's
    taken words differ from its target by about the root of its summed squared sizes: with few documents, or
    one that holds much of the source, that can be a large part (0.42 to 1.22 of it for sources of 50 documents).
    """
    size, total, target, copies = (free_name(docs, n) for n in ("size", "source_size", "target", "copies"))
    text = column(text_col)
    counted = docs.withColumn(size, F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"))
    t = source_targets(counted.select(column(source_col).alias("source"), F.col(size).alias("size")))
    of = free_name(counted, "__source")
    t = t.select(F.col("source").alias(of), F.col("source_size").alias(total), F.col("target").alias(target))
    # One row a source: broadcast while they are few, otherwise joined by shuffle, where AQE splits a hot source.
    out = counted.join(sized(t, 100_000), column(source_col).eqNullSafe(F.col(of)), "left").drop(of)
    rate = F.when(F.col(total) > 0, F.least(F.col(target) / F.col(total), F.lit(float(MOST_REPEATS)))).otherwise(F.lit(0.0))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce(column(id_col).cast("string"), F.lit("null")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return out.withColumn(copies, (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long"))


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mixed corpus: each row of docs as often as with_copies says, with the columns of docs."""
    out = with_copies(docs, seed)
    copies, turn = out.columns[-1], free_name(out, "__copy")
    repeat = F.explode(F.when(F.col(copies) > 0, F.sequence(F.lit(1).cast("long"), F.col(copies))).otherwise(F.array().cast("array<bigint>")))
    return out.withColumn(turn, repeat).select(*map(column, docs.columns))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's share in the mix; see with_copies for nulls, ties and repeated rows, source_targets for empty tables."""
    out = with_copies(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w, CAST(3 AS DOUBLE) * source_size AS cap FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s)
        - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT max(lv) FROM l WHERE lv <= cap / w) * w, cap)) AS target FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
        CAST(('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8)) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS draw
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
