"""WARC archives: writing with revisit records, and reading with boundary-chain verification.

An archive is text to Spark: records are strings ended by the format's two line ends, so Spark's own
writer makes the files, on any store, and its commits survive lost tasks.

Reading cuts the files at every version line, also those inside payloads, in parallel. Each cut is a
candidate record, whose header tells where the next record must start. Following these successors from
the file's start, by pointer jumping, reaches the true records only; what starts at other cuts is
payload, and is joined to the record that it lies in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.llm.common import column, saved, shared_folder, sized, sized_texts, table

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
#: Bytes from which equal payloads are stored once.
REVISIT_BYTES = 100
#: Links up to which pointer jumping broadcasts one side, and the partitions of its tables then; more links are shuffled.
BROADCAST_LINKS, PARTS = 100_000, 16
_LINE = "\r\n"
_CUT = VERSION + _LINE
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """pages (page_id, url, html) with payload, payload_bytes, payload_digest, record_type and refers_to.

    Null html is the empty payload. Of equal payloads of at least `least` bytes, the row with the smallest
    page_id is the response; rows with another page_id revisit it. Rows of that same page_id (repeated
    rows) and of a null one are responses too. Only (digest, page_id) is shuffled to find them, summed before it
    is sent; AQE splits a payload that very many pages share.
    """
    payload = F.coalesce(column("html"), F.lit(""))
    p = pages.select(column("page_id").cast("long").alias("page_id"), column("url").cast("string").alias("url"), payload.alias("payload"))
    p = p.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2(F.encode("payload", "utf-8"), 256))
    large = p.where(F.col("payload_bytes") >= least)
    first = large.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last")
    p = p.join(sized(first.select("payload_digest", "first")), "payload_digest", "left")
    again = F.col("first").isNotNull() & (F.col("page_id") > F.col("first")) & (F.col("payload_bytes") >= least)
    p = p.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("first")))
    return p.drop("first")


def _uri(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def record(p: DataFrame) -> Column:
    """The record of a row of with_revisits(), without the two line ends after it. White space and control characters in a url are percent-encoded."""
    url = F.coalesce(F.col("url"), F.lit(""))
    url = F.regexp_replace(url, "[\\x00-\\x20\\x7f]", "%20")
    revisit = F.col("record_type") == "revisit"
    head = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), _uri(F.col("page_id"))),
        F.lit("WARC-Date: " + DATE),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _uri(F.col("refers_to")), F.lit(f"{_LINE}WARC-Profile: {_PROFILE}{_LINE}X-Payload-Length: "), F.col("payload_bytes").cast("string"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, "0").otherwise(F.col("payload_bytes").cast("string"))),
    ]
    return F.concat(F.concat_ws(_LINE, *head), F.lit(2 * _LINE), F.when(revisit, "").otherwise(F.col("payload")))


def write(pages: DataFrame, folder: str) -> None:
    """Writes pages as .warc text files to folder, one file a task."""
    p = with_revisits(pages)
    p.select(record(p).alias("value")).write.option("lineSep", 2 * _LINE).text(folder)


def cuts(spark: SparkSession, folder: str) -> DataFrame:
    """(file, block, row, bytes, head, length, body): the text from each version line to the next one, saved.

    body is the text after the version line, head its part up to the first blank line (null without one),
    length what the header says. Files may be split among tasks anywhere; the rows of a file are ordered by row.
    """
    raw = spark.read.option("lineSep", _CUT).text(folder)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("body"))
    end = F.locate(2 * _LINE, F.col("body"))
    raw = raw.withColumn("head", F.when(end > 0, F.expr(f"substr(body, 1, locate('\\r\\n\\r\\n', body) + {2 * len(_LINE) - 1})")))
    length = F.regexp_extract("head", r"(?i)(?:\A|\n)Content-Length:[ \t]*(\d+)[ \t]*\r\n", 1).try_cast("long")
    raw = raw.withColumn("length", length).withColumn("bytes", F.octet_length("body").cast("long")).withColumn("head_bytes", F.octet_length("head").cast("long"))
    # Packed tighter than usual: these are the archive's own bytes once more.
    path = shared_folder(spark, "cuts")
    raw.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(raw.schema).parquet(path)


def candidates(cut: DataFrame) -> DataFrame:
    """(file, row, offset, next) of cuts: where each version line stands and where its record would end.

    next is null where the text is no record's start: no blank line after it, or no length. Offsets count bytes.
    """
    # The text before a file's first version line is a row too, and the file's first; every other row follows a version line.
    size = cut.select("file", "block", "row", "bytes", "head_bytes", "length")
    inside = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    per_block = size.groupBy("file", "block").agg((F.sum("bytes") + len(_CUT) * F.count("*")).alias("all"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = per_block.select("file", "block", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("before"))
    placed = size.withColumn("inside", F.coalesce(F.sum(F.col("bytes") + len(_CUT)).over(inside), F.lit(0))).join(sized(before), ["file", "block"])
    offset = F.col("before") + F.col("inside") - len(_CUT)
    placed = placed.withColumn("offset", offset).where("offset >= 0")
    return placed.select("file", "row", "offset", (F.col("offset") + len(_CUT) + F.col("head_bytes") + F.col("length") + 2 * len(_LINE)).alias("next"))


def reachable(c: DataFrame, rounds: int = 60) -> DataFrame:
    """(file, offset) of the candidates that the chain of successors reaches from each file's start (offset 0).

    Pointer jumping: marks start at offset 0; in each round every marked record marks the record that
    its pointer names, and all pointers double their reach. A file of n records takes log2(n) rounds.
    """
    links = c.where("next IS NOT NULL").select("file", "offset", "next")
    there = links.select("file", F.col("offset").alias("next"))
    jump = saved(links.join(there, ["file", "next"], "left_semi"), "chain")
    marked = links.where("offset = 0").select("file", "offset")
    # Marks and pointers are among the links: their number bounds what is broadcast in every round.
    few = links.count() <= BROADCAST_LINKS
    side, packed = (F.broadcast, lambda df: df.coalesce(PARTS)) if few else ((lambda df: df),) * 2
    n = -1
    for _ in range(rounds):
        new = jump.join(side(marked), ["file", "offset"]).select("file", F.col("next").alias("offset"))
        marked = saved(packed(marked.union(new).distinct()), "marked")
        m = marked.count()
        if m == n:
            return marked
        n = m
        far = jump.select("file", F.col("offset").alias("next"), F.col("next").alias("far"))
        jump = saved(packed(jump.join(side(far), ["file", "next"]).select("file", "offset", F.col("far").alias("next"))), "chain")
    raise RuntimeError("a chain of records did not end")


def _field(name: str) -> Column:
    return F.regexp_extract("head", rf"(?i)(?:\A|\n){name}:[ \t]*([^\r\n]*)", 1)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of the records of an archive folder.

    Bytes and digest are those of the payload read; for a revisit, which has none, those its header names.
    """
    cut = cuts(spark, folder)
    c = saved(candidates(cut), "candidates")
    true = reachable(c).withColumn("start", F.col("offset"))
    # Each cut belongs to the last true record at or before it, found on offsets alone; then the texts of records that their payload cuts are joined up.
    upto = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = c.join(true, ["file", "offset"], "left").select("file", "row", "offset", F.last("start", ignorenulls=True).over(upto).alias("start"))
    at = saved(at.where("start IS NOT NULL"), "places")
    inner = sized(at.where("start <> offset").select("row", "offset", "file", "start")).join(cut.select("row", "body"), "row")
    body = F.transform(F.array_sort(F.collect_list(F.struct("offset", "body"))), lambda x: F.concat(F.lit(_CUT), x["body"]))
    rest = inner.groupBy("file", "start").agg(F.array_join(body, "").alias("rest"))
    first = at.where("start = offset").join(rest, ["file", "start"], "left").select("row", "rest")
    r = cut.select("row", "head", "body").join(sized(at.where("start = offset").select("row")), "row", "left_semi")
    r = r.join(sized_texts(first.where("rest IS NOT NULL"), "rest", 1_000), "row", "left")
    r = r.withColumn("payload", F.concat(F.expr("substr(body, length(head) + 1)"), F.coalesce("rest", F.lit(""))))
    r = r.withColumn("payload", F.expr(f"substr(payload, 1, length(payload) - {2 * len(_LINE)})"))
    kind = F.lower(_field("WARC-Type"))
    number = lambda name: F.regexp_extract(_field(name), r"<urn:page:(\d+|-\d+)>", 1).try_cast("long")
    revisit = F.col("record_type") == "revisit"
    r = r.select(
        number("WARC-Record-ID").alias("page_id"), _field("WARC-Target-URI").alias("url"), "payload", kind.alias("record_type"), number("WARC-Refers-To").alias("refers_to"),
        _field("WARC-Payload-Digest").alias("named"), _field("X-Payload-Length").alias("told"),
    )
    own = F.sha2(F.encode("payload", "utf-8"), 256)
    return r.select(
        "page_id", "url", "payload",
        F.when(revisit, F.col("told").try_cast("long")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("named", "^sha256:", "")).otherwise(own).alias("payload_digest"),
        "record_type", "refers_to",
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as written to an archive and read back. Null pages are empty payloads, repeated rows are records of their own, no pages give no rows."""
    folder = shared_folder(spark, "warc")
    write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = r"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""
