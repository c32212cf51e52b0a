"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

Two kinds of entries are listed together: rules (a host with its subdomains, and the start of a path) and
whole canonical URLs. A url asks for all keys that could list it. The filter, one row of 256 bits a block,
passes the possible hits; the exact join with the list removes the false positives. Of the rules that
fit, the longest decides; a url that none fits is blocked if its canonical form is listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import column, free_name, saved, sized, table

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Pages of fewer words are thin: the query lists their canonical urls.
THIN_WORDS = 50
BITS_PER_KEY = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null and without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null and without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www., path without a last slash or .html; scheme, query and fragment go. Empty for null and without ://."""
    return F.concat(F.regexp_replace(host_of(url), r"\Awww\.", ""), F.regexp_replace(path_of(url), r"(/|\.html)\z", ""))


def _bits(key: Column) -> tuple[Column, list[Column]]:
    """A key's hash for its block, and the four words of its eight bits there."""
    h = F.xxhash64(key, F.lit(42))
    spots = [F.shiftrightunsigned(h, 8 * i).bitwiseAND(F.lit(255)) for i in range(8)]
    one = F.lit(1).cast("long")
    bits = [F.call_function("shiftleft", one, s.bitwiseAND(F.lit(63)).cast("int")) for s in spots]
    words = []
    for w in range(4):
        word = F.lit(0).cast("long")
        for s, bit in zip(spots, bits, strict=True):
            word = word.bitwiseOR(F.when(F.shiftright(s, 6) == w, bit).otherwise(F.lit(0).cast("long")))
        words.append(word)
    return F.xxhash64(key), words


def bloom(listed: DataFrame) -> tuple[DataFrame, int]:
    """The filter of listed (key): (block, w0..w3), and its number of blocks, a power of two by the list's length."""
    n = listed.count()
    blocks = 1
    while blocks * 256 < n * BITS_PER_KEY:
        blocks *= 2
    at, words = _bits(F.col("key"))
    rows = listed.select(F.pmod(at, F.lit(blocks)).alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(words)])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)]), blocks


def judged(pages: DataFrame, rules: DataFrame, listed: DataFrame, url_col: str = "url") -> DataFrame:
    """pages with the columns host, path, rule and verdict.

    rules: (host, path, verdict); listed: (url), canonical forms to block. Of equally long rules the one
    first in code point order wins. Null urls and urls without :// have an empty host and path, fit no rule
    and are allowed. Equal urls are looked up once. Clashing columns of pages stay; ours get a leading underscore.
    """
    host_n, path_n, rule_n, verdict_n = (free_name(pages, n) for n in ("host", "path", "rule", "verdict"))
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL").select(F.concat("host", "path").alias("rule"), "verdict", F.length("path").alias("cut")).dropDuplicates(["rule"])
    lengths = sorted(r[0] for r in rules.select("cut").distinct().collect())  # of paths: a bounded number
    entries = rules.select(F.concat(F.lit("r"), "rule").alias("key"), "rule", "verdict").union(
        listed.where("url <> ''").distinct().select(F.concat(F.lit("u"), "url").alias("key"), F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict"))
    )
    entries = saved(entries, "listed")
    blocks, number = bloom(entries)

    url = pages.select(column(url_col).alias("url")).where("url IS NOT NULL").distinct()
    url = url.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical(F.col("url")).alias("canonical")).where("host <> '' OR path <> ''")
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    cuts = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("path"))
    keys = F.flatten(F.transform(above, lambda h: F.transform(cuts, lambda n: F.concat(F.lit("r"), h, F.substring(F.col("path"), F.lit(1), n)))))
    asked = url.select("url", F.explode(F.array_union(keys, F.array(F.concat(F.lit("u"), "canonical")))).alias("key"))
    at, words = _bits(F.col("key"))
    asked = asked.select("url", "key", F.pmod(at, F.lit(number)).alias("block"), *[w.alias(f"m{i}") for i, w in enumerate(words)])
    hit = asked.join(sized(blocks), "block")
    for i in range(4):
        hit = hit.where(F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}"))
    exact = hit.select("url", "key").join(sized(entries), "key")
    order = F.struct(F.when(F.col("rule").isNull(), 1).otherwise(0).alias("kind"), (-F.length("rule")).alias("size"), "rule", "verdict")
    best = exact.groupBy("url").agg(F.min(order).alias("best")).select("url", "best.rule", "best.verdict")
    best = best.toDF(*(own := [free_name(pages, n) for n in ("__url", "__rule", "__verdict")]))
    u = column(url_col)
    out = pages.join(best, u == F.col(own[0]), "left")
    out = out.withColumn(host_n, host_of(u)).withColumn(path_n, path_of(u)).withColumn(rule_n, F.col(own[1])).withColumn(verdict_n, F.coalesce(own[2], F.lit("allow")))
    return out.drop(*own)


def thin_pages(pages: DataFrame, least: int = THIN_WORDS) -> DataFrame:
    """(url): canonical urls of pages whose html, without tags, has fewer than least words."""
    words = F.coalesce(F.regexp_count(F.regexp_replace("html", "<[^>]*>", " "), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    return pages.where(words < least).select(canonical(F.col("url")).alias("url")).where("url <> ''")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict; see judged for nulls, repeated urls and empty tables."""
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return judged(pages.select("page_id", "url"), rules, thin_pages(pages)).drop("url")


OP7_SQL = r"""
WITH p AS (SELECT page_id, html, url,
    translate(coalesce(regexp_extract(url, '(?s)\A.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)\A.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
c AS (SELECT *, concat(regexp_replace(host, '\Awww\.', ''), regexp_replace(path, '(/|\.html)\z', '')) AS canonical FROM p),
listed AS (SELECT DISTINCT canonical FROM c WHERE canonical <> ''
  AND coalesce(len(regexp_extract_all(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[^\x20\x09-\x0D]+')), 0) < 50),
r AS (SELECT page_id, host, path, canonical, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM c)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
