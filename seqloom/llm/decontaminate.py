"""Benchmark decontamination: finds runs of benchmark words in documents, and removes these spans or the documents.

The windows of the benchmark's items (consecutive words, normalised) become a set of hashes, broadcast to all tasks. A task
slides over the words of a few megabytes of text at a time, looks all windows up, compares the words of each hit, and marks the
words inside. The set is bounded: a benchmark of more than PART_BYTES is cut into parts, whose sets are sent one after
another, and the marks of a part are written to the shared folder before the next one is sent.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seqloom.llm.common import column, forget, free_name, saved, ship, table
from seqloom.llm.shingles import _BACK, _BASE, _powers, mixed, words

WIDTH = 10
#: Bytes of benchmark text, normalised, whose windows are sent to all tasks at a time: the bound of the broadcast.
PART_BYTES = 16 << 20
#: Words of a piece of an item; longer items are cut into pieces that overlap by a window less a word.
PIECE_WORDS = 20_000
#: Bytes of text that a task slides over at a time, about; a longer text is taken by itself.
SLICE = 2 << 20
#: The set's first filter has this many bits a window, at least.
BITS = 16

#: What keeps words apart: bytes below 0x80 that are neither digits nor small letters.
APART = np.ones(256, dtype=bool)
APART[0x30:0x3A] = APART[0x61:0x7B] = APART[0x80:] = False
_APART = re.compile(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def normalised(text: str) -> bytes:
    """The words of text, A-Z lower-cased, one space between two."""
    return _APART.sub(b" ", text.encode("utf-8", "surrogatepass").lower()).strip(b" ")


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width consecutive words, from the words' hashes."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * _powers(_BASE, len(h)), out=total[1:])
    return mixed((total[width:] - total[:n]) * _powers(_BACK, n) + np.uint64(width))


@dataclass
class Windows:
    """The different windows of one width: hashes (ascending, repeated if words differ), words, and the items of window i: items[starts[i]:starts[i + 1]]."""

    width: int
    hashes: np.ndarray
    words: list[bytes]
    items: np.ndarray
    starts: np.ndarray
    bits: np.ndarray

    def maybe(self, h: np.ndarray) -> np.ndarray:
        """Places of h whose hash the set may have."""
        at = np.flatnonzero(self.bits[(h & np.uint64(len(self.bits) - 1)).astype(np.int64)])
        low = np.searchsorted(self.hashes, h[at])
        return at[(low < len(self.hashes)) & (self.hashes[np.minimum(low, len(self.hashes) - 1)] == h[at])]


def windows(items: list[tuple[int, bytes]], width: int) -> list[Windows]:
    """The windows of items (number, normalised text): of width words, or all the words of an item that has fewer; one Windows a width."""
    found: dict[int, dict[bytes, set[int]]] = {}
    for number, raw in items:
        parts = raw.split(b" ") if raw else []
        n = min(width, len(parts))
        for i in range(len(parts) - n + 1 if n else 0):
            found.setdefault(n, {}).setdefault(b" ".join(parts[i : i + n]), set()).add(number)
    out = []
    for n, of in sorted(found.items()):
        texts = list(of)
        hashes = np.array([window_hashes(words(t, APART)[0], n)[0] for t in texts], dtype=np.uint64)
        order = np.argsort(hashes, kind="stable")
        hashes, texts = hashes[order], [texts[i] for i in order]
        starts = np.cumsum([0] + [len(of[t]) for t in texts])
        bits = np.zeros(1 << max(10, (BITS * len(texts) - 1).bit_length()), dtype=bool)
        bits[(hashes & np.uint64(len(bits) - 1)).astype(np.int64)] = True
        out.append(Windows(n, hashes, texts, np.array([i for t in texts for i in sorted(of[t])], dtype=np.int64), starts, bits))
    return out


def _merged(ranges: np.ndarray) -> np.ndarray:
    """Ranges (first, behind the last) ascending, those that touch or overlap as one."""
    if len(ranges) < 2:
        return ranges
    ranges = ranges[np.lexsort((ranges[:, 1], ranges[:, 0]))]
    ends = np.maximum.accumulate(ranges[:, 1])
    new = np.concatenate(([True], ranges[1:, 0] > ends[:-1]))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(ranges) - 1]))
    return np.stack((ranges[new, 0], ends[last]), axis=1)


def scan(texts: list[str | None], sets: list[Windows], before: list[list[int]] | None = None) -> list[tuple[int, np.ndarray, set[int], np.ndarray]]:
    """For each text: its number of words, hit ranges of words, the numbers of items hit, and the hit ranges' byte offsets.

    before: ranges that other sets have found in each text; they are among the hit ranges.
    """
    raws = [t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in texts]
    # One line feed stands behind each text, so that no word goes over its end.
    begins = np.cumsum([0] + [len(r) + 1 for r in raws])
    whole = b"\n".join(raws)
    h, start, end = words(whole, APART)
    first = np.searchsorted(start, begins)  # each text's first word, and behind the last text's last
    text_of = np.repeat(np.arange(len(raws)), np.diff(first))
    ranges: dict[int, list] = {}
    items: dict[int, set[int]] = {}
    for t, was in enumerate(before or ()):
        if was:
            ranges[t] = [(a + first[t], z + first[t]) for a, z in zip(was[::2], was[1::2], strict=True)]
    for s in sets:
        w = window_hashes(h, s.width)
        if not len(w):
            continue
        at = s.maybe(w)
        at = at[text_of[at] == text_of[at + s.width - 1]]
        for p in at.tolist():
            said = _APART.sub(b" ", whole[start[p] : end[p + s.width - 1]])
            i = int(np.searchsorted(s.hashes, w[p]))
            while i < len(s.hashes) and s.hashes[i] == w[p]:
                if s.words[i] == said:
                    t = int(text_of[p])
                    ranges.setdefault(t, []).append((p, p + s.width))
                    items.setdefault(t, set()).update(s.items[s.starts[i] : s.starts[i + 1]].tolist())
                i += 1
    out = []
    none = np.zeros((0, 2), dtype=np.int64)
    for t in range(len(raws)):
        n = int(first[t + 1] - first[t])
        if t not in ranges:
            out.append((n, none, set(), none))
            continue
        got = _merged(np.array(ranges[t], dtype=np.int64))
        out.append((n, got - first[t], items.get(t, set()), np.stack((start[got[:, 0]], end[got[:, 1] - 1]), axis=1) - begins[t]))
    return out


def _char_spans(text: str, spans: np.ndarray) -> list[dict[str, int]]:
    """Byte ranges of text as ranges of characters."""
    raw, out, at, chars = text.encode("utf-8", "surrogatepass"), [], 0, 0
    for a, z in spans.tolist():
        chars += len(raw[at:a].decode("utf-8", "surrogatepass"))
        begin, chars = chars, chars + len(raw[a:z].decode("utf-8", "surrogatepass"))
        out.append({"begin": begin, "end": chars})
        at = z
    return out


def _pieces(benchmark: DataFrame, width: int, id_col: str, text_col: str, piece_words: int) -> DataFrame:
    """(item, raw): the normalised items, long ones in overlapping pieces, each different row once; items without words are left out."""

    def cut(batches):
        for b in batches:
            rows = []
            for item, text in zip(b["item"], b["text"], strict=True):
                parts = normalised(text).split(b" ") if text else []
                for i in range(0, max(1, len(parts) - width + 1), piece_words):
                    if parts and parts[0]:
                        rows.append((item, b" ".join(parts[i : i + piece_words + width - 1])))
            yield pd.DataFrame(rows, columns=["item", "raw"])

    rows = benchmark.select(column(id_col).cast("string").alias("item"), column(text_col).alias("text"))
    return rows.mapInPandas(cut, "item string, raw binary").distinct()


def _parts(pieces: DataFrame, most: int) -> int:
    """Into how many parts by hash pieces are cut, so that none has over `most` bytes, unless it is one piece."""
    size = F.octet_length("raw") + 1
    n = 1
    while True:
        part = F.pmod(F.xxhash64("item", "raw"), F.lit(n))
        over = pieces.groupBy(part.alias("part")).agg(F.sum(size).alias("bytes"), F.count("*").alias("rows")).where((F.col("bytes") > most) & (F.col("rows") > 1))
        if over.isEmpty():
            return n
        n *= 2


def scanned(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    keep_text: bool = True, part_bytes: int = PART_BYTES, piece_words: int = PIECE_WORDS,
) -> DataFrame:
    """docs with n_words, n_hit, items (array<string>, ascending), spans (array of begin and end in characters) and contaminated.

    Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII. A window is width consecutive words of an
    item, or all words of an item with fewer; items without words have none. A document's word inside any occurrence of a window, word for word, is hit;
    spans are the runs of hit words. Null and empty texts have no words. Rows of one item id are one item; those of a null id
    mark words, but aren't listed in items. Repeated documents are judged alike. Clashing columns of docs stay, ours get an
    underscore. Empty tables of either kind give no hits. keep_text: else the text is left out of the result.
    """
    ship(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    pieces = saved(_pieces(benchmark, width, item_col, item_text_col, piece_words), "pieces")
    n = _parts(pieces, part_bytes)
    named = {c: free_name(docs, c) for c in ("n_words", "n_hit", "items", "spans", "contaminated")}
    state = {c: free_name(docs, f"{c}__") for c in ("n", "ranges", "items", "spans")}
    kinds = {"n": "bigint", "ranges": "array<bigint>", "items": "array<string>", "spans": "array<struct<begin:bigint,end:bigint>>"}
    keep = lambda last: [f for f in docs.schema.fields if f.name != text_col or keep_text or not last]

    def one_part(rows: DataFrame, part: int, before: bool, last: bool) -> DataFrame:
        got = pieces.where(F.pmod(F.xxhash64("item", "raw"), F.lit(n)) == part).collect()
        names = sorted({r["item"] for r in got if r["item"] is not None})
        number = {item: i for i, item in enumerate(names)} | {None: -1}
        sent = context.broadcast((windows([(number[r["item"]], bytes(r["raw"])) for r in got], width), names))
        schema = StructType([*keep(last), *StructType.fromDDL(", ".join(f"`{state[c]}` {kind}" for c, kind in kinds.items()))])
        others = [f.name for f in keep(last)]

        def mark(batches):
            sets, of = sent.value
            for b in batches:
                texts = b.column(text_col).to_pylist()
                sizes = np.cumsum([len(t) if t else 0 for t in texts]) // SLICE
                cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(texts)] if texts else [0]
                for a, z in zip(cuts, cuts[1:], strict=False):
                    out = {c: [] for c in kinds}
                    was = {c: b.column(state[c]).slice(a, z - a).to_pylist() for c in ("ranges", "items")} if before else {}
                    for i, (count, ranges, items, spans) in enumerate(scan(texts[a:z], sets, was.get("ranges"))):
                        listed = {of[x] for x in items if x >= 0}.union(was["items"][i] if before else ())
                        chars = _char_spans(texts[a + i], spans) if len(spans) else []
                        for c, v in zip(kinds, (count, ranges.ravel().tolist(), sorted(listed), chars), strict=True):
                            out[c].append(v)
                    new = [pa.array(out["n"], pa.int64()), pa.array(out["ranges"], pa.list_(pa.int64())), pa.array(out["items"], pa.list_(pa.string())), pa.array(out["spans"], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))]
                    yield pa.RecordBatch.from_arrays([*[b.column(c).slice(a, z - a) for c in others], *new], [*others, *state.values()])

        return rows.mapInArrow(mark, schema)

    rows, was = docs, None
    for part in range(n):
        last = part == n - 1
        rows = one_part(rows, part, part > 0, last)
        if not last:
            rows = saved(rows, "marks")
        if was is not None and not last:
            forget(was)
        was = rows
    forget(pieces)
    # Runs of hit words: ranges are pairs of the first word and the one behind the last.
    hit = F.aggregate(column(state["ranges"]), F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("sign")), lambda s, x: F.struct((s["n"] + s["sign"] * x).alias("n"), (-s["sign"]).alias("sign")))["n"]
    new = {"n_words": column(state["n"]), "n_hit": hit, "items": column(state["items"]), "spans": column(state["spans"]), "contaminated": F.size(column(state["ranges"])) > 0}
    return rows.select(*[column(f.name) for f in keep(True)], *[c.alias(named[k]) for k, c in new.items()])


def decontaminated(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", text_col: str = "text", **options) -> DataFrame:
    """docs, in the same columns, without benchmark words: their spans cut out of texts, or (remove="documents") contaminated documents left out.

    See scanned for what is hit, its options, nulls, repeated rows and empty tables. What stands between the words of a span goes with it.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove is spans or documents")
    renamed = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("doc"), column(text_col).alias("text"))
    got = scanned(renamed, benchmark, text_col="text", **options)
    if remove == "documents":
        return got.where(~F.col("contaminated")).select("doc.*")
    # The text between spans: what stands behind the end of the one before, up to the begin of the next one.
    size = F.size("spans")
    begin = lambda i: F.coalesce(F.get("spans", i - 1)["end"], F.lit(0))
    end = lambda i: F.coalesce(F.get("spans", i)["begin"], F.length("text").cast("long"))
    rest = F.array_join(F.transform(F.sequence(F.lit(0), size), lambda i: F.substring("text", (begin(i) + 1).cast("int"), (end(i) - begin(i)).cast("int"))), "")
    text = F.when(F.col("contaminated"), rest).otherwise(F.col("text"))
    return got.select(*[text.alias(c) if c == text_col else column("doc")[c].alias(c) for c in docs.columns])


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """What scanned finds, of documents (doc_id, text), as numbers and a digest: sha256 of the items sorted as strings and joined by commas."""
    got = scanned(docs, benchmark, keep_text=False)
    sha = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), sha.alias("items_sha256"), "contaminated")


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, hit words and items hit; see scanned for nulls, ties, repeated rows and empty tables."""
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


_WORDS = r"list_filter(string_split_regex(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

OP12_SQL = rf"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format(text="text")} AS w FROM benchmark WHERE text IS NOT NULL),
wide AS (SELECT item, w, least({WIDTH}, len(w)) AS n FROM items WHERE len(w) > 0),
grams AS (SELECT DISTINCT item, n, array_to_string(w[i + 1 : i + n], ' ') AS gram FROM (SELECT *, unnest(range(len(w) - n + 1)) AS i FROM wide)),
docs AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, CASE WHEN text IS NULL THEN [] ELSE {_WORDS.format(text="text")} END AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM grams),
slides AS (SELECT row, n, i, array_to_string(w[i + 1 : i + n], ' ') AS gram FROM (SELECT row, w, n, unnest(range(greatest(0, len(w) - n + 1))) AS i FROM docs, sizes)),
hits AS MATERIALIZED (SELECT row, s.n, i, item FROM slides s JOIN grams g ON s.gram = g.gram AND s.n = g.n),
marked AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, i + unnest(range(n)) AS p FROM hits) GROUP BY row),
listed AS (SELECT row, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits WHERE item IS NOT NULL GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN marked USING (row) LEFT JOIN listed USING (row)
"""
