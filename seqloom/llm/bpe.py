"""Byte-level BPE encoding and decoding by ranked merges.

Words are matches of the pattern. They are counted over the whole corpus, and the distinct ones that recur are
encoded by Spark's higher-order functions: a fold over the word's bytes merges, at each step, the adjacent
pair of least rank, looked up in a rank map. Their ids make a dictionary of a fixed size bound, sent to
all tasks. Tasks then encode whole texts by look-ups, and fold the words outside the dictionary, most of which the
corpus has once, by the same rule. Decoding concatenates the ids' byte strings, in Spark.

Texts are cut in runs where a space or line feed stands between two non-space characters; there the pattern's
matches end whatever surrounds them, so a run's ids don't depend on its place.
"""

from __future__ import annotations

import base64
import collections
import heapq
import re
import uuid
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from seqloom.llm.common import column, free_name, most_counted, saved, table

#: Words of the dictionary, at most: a fixed bound of what is sent to every task. Longer ones than LONGEST bytes are left to the tasks.
DICTIONARY = 200_000
LONGEST = 64
#: Distinct runs that a task counts at a time; then it starts anew.
COUNTED = 200_000
#: Runs whose ids a Python worker keeps; then it forgets those that it hasn't met lately.
KEPT = 300_000
#: Buckets of the rank map.
BUCKETS = 1 << 15
_NONE, _TOKEN = 1 << 30, 1 << 25

#: Unicode white space, as the pattern's \s means it (fixed values).
SPACE = "\t-\r \x85\xa0  -     　"
_RUN = re.compile(f"([{SPACE}]{{2,}})")
_MARK = "\x01"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def words_of(text: str) -> list[str]:
    """text cut at safe places; joined again it is text."""
    if _MARK in text:
        return [text]
    out = []
    parts = _RUN.split(text) if _RUN.search(text) else [text]
    head = ""
    for i, part in enumerate(parts):
        if i % 2:  # a run of white space: all but its last character is one match, all of it at the end
            last = i == len(parts) - 2 and not parts[-1]
            out.append(part if last else part[:-1])
            head = "" if last else part[-1]
        else:
            out += (head + part).replace("\n", _MARK + "\n" + _MARK).replace(" ", _MARK + " ").split(_MARK)
    return list(filter(None, out))


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """The rank of each pair of entries that make an entry, by left id * 2**16 + right id."""
    if max(ranks.values()) >= 1 << 16:
        raise ValueError("the vocabulary has 2**16 ids or more")
    cuts = ((ranks.get(b[:i]), ranks.get(b[i:]), rank) for b, rank in ranks.items() for i in range(1, len(b)))
    return {left << 16 | right: rank for left, right, rank in cuts if left is not None and right is not None}


class Fold:
    """Ids of one word: the adjacent pair of least rank, leftmost first, is merged until none has a rank. An entry's id is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.pairs = ranks, pair_ranks(ranks)
        self.of_byte = [ranks[bytes([i])] for i in range(256)]

    def __call__(self, word: bytes) -> list[int]:
        if len(word) > LONGEST:
            return _long_fold(word, self.ranks)
        rank = self.pairs.get
        ids = [self.of_byte[x] for x in word]
        low_of = [rank(a << 16 | b, _NONE) for a, b in zip(ids, ids[1:])]  # noqa: B905
        while low_of:
            low = min(low_of)
            if low == _NONE:
                break
            i = low_of.index(low)
            del ids[i + 1], low_of[i]
            ids[i] = low
            if i < len(low_of):
                low_of[i] = rank(low << 16 | ids[i + 1], _NONE)
            if i:
                low_of[i - 1] = rank(ids[i - 1] << 16 | low, _NONE)
        return ids


def _long_fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of pairs, so that a word of n bytes takes n log n steps."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n))  # of the part that starts here
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, z = heapq.heappop(heap)
        if not alive[i] or end[i] >= z or end[end[i]] != z:
            continue
        alive[end[i]] = False
        end[i] = z
        if z < n:
            before[z] = i
            if (r := ranks.get(word[i : end[z]])) is not None:
                heapq.heappush(heap, (r, i, end[z]))
        if i and (r := ranks.get(word[before[i] : z])) is not None:
            heapq.heappush(heap, (r, before[i], z))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def compiled(pattern: str) -> regex.Pattern:
    """The pattern, with white space as Unicode has it."""
    return regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))


class Coder:
    """Encodes and decodes single texts in this process, by the same rules."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.fold, self.pieces = Fold(ranks), compiled(pattern)
        self.of_id = {str(i).encode(): b for b, i in ranks.items()}

    def encode(self, text: str | None) -> bytes:
        """Decimal ids joined by commas; null as the empty text."""
        words = (m.encode("utf-8", "surrogatepass") for run in words_of(text or "") for m in self.pieces.findall(run))
        return ",".join(str(i) for w in words for i in self.fold(w)).encode()

    def decode(self, digits: bytes) -> bytes:
        return b"".join(map(self.of_id.__getitem__, digits.split(b","))) if digits else b""


def _sent(value: pa.Array) -> Column:
    """The one element of value, read by a subquery: plans, whose descriptions the driver keeps, don't spell it out as they would a literal."""
    return SparkSession.active().createDataFrame(pa.table({"value": value})).scalar()


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The ranks of pairs of ids as an array of buckets: each _NONE, then keys, a rank behind each.

    Keys are (left + 1) * 2**16 + right as 32-bit integers, which no rank of a vocabulary under 2**16 equals.
    """
    buckets: list[list[int]] = [[_NONE] for _ in range(BUCKETS)]
    for pair, rank in pair_ranks(ranks).items():
        left, right = pair >> 16, pair & 0xFFFF
        key = (left + 1) << 16 | right
        buckets[(left * 40503 + right) % BUCKETS] += [key - (1 << 32) if key >= 1 << 31 else key, rank]
    return _sent(pa.array([buckets], pa.list_(pa.list_(pa.int32()))))


def _bound(value: Column, f) -> Column:
    """f(value), with value worked out once: a lambda's variable holds it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def folded(word: Column, maps: Column, of_byte: Column) -> Column:
    """array<int>: the ids of a string column that is one word, by a fold over its byte array.

    The state is one array: _NONE, then each part's id (plus _TOKEN) and behind it the rank of its pair with
    the next part (_NONE where there is none). So the least element is the least rank, and its first place the leftmost pair's.
    """
    none, all_ = F.lit(_NONE), F.lit(1 << 24)
    raw = F.transform(F.split(F.decode(F.encode(word, "utf-8"), "ISO-8859-1"), ""), lambda c: F.get(of_byte, F.ascii(c)))
    ident = lambda x: x.bitwiseAND(F.lit(0xFFFF))

    def rank(left: Column, right: Column) -> Column:
        bucket = F.get(maps, (left * 40503 + right).bitwiseAND(F.lit(BUCKETS - 1)))
        key = F.shiftleft(left + 1, 16).bitwiseOR(right)
        return F.coalesce(F.get(bucket, F.array_position(bucket, key).cast("int")), none)

    def start(p: Column) -> Column:
        pairs = F.transform(p, lambda x, i: F.array(x.bitwiseOR(F.lit(_TOKEN)), rank(x, F.get(p, i + 1))))
        return F.flatten(F.array(F.array(none), F.flatten(pairs)))

    def merge(z: Column, low: Column, at: Column) -> Column:
        left, right = rank(ident(F.get(z, at - 4)), low), rank(low, ident(F.get(z, at + 2)))
        return F.flatten(F.array(F.slice(z, F.lit(1), at - 3), F.array(left, low.bitwiseOR(F.lit(_TOKEN)), right), F.slice(z, at + 3, all_)))

    def step(z: Column, _: Column) -> Column:
        return _bound(F.array_min(z), lambda low: F.when(low < F.lit(_TOKEN), _bound(F.array_position(z, low).cast("int"), lambda at: merge(z, low, at))).otherwise(z))

    ids = lambda z: F.transform(F.filter(z, lambda x: (x < none) & (x >= F.lit(_TOKEN))), ident)
    return F.aggregate(F.sequence(F.lit(2), F.greatest(F.octet_length(word), F.lit(2))), _bound(raw, start), step, ids)


def folded_all(words: Column, maps: Column, ranks: dict[bytes, int]) -> Column:
    """array<array<int>>: folded() of each word of an array. maps: rank_map(), as a column of its own, since higher-order functions take no subquery."""
    of_byte = F.array(*[F.lit(ranks[bytes([i])]) for i in range(256)])
    literals = F.struct(maps.alias("maps"), of_byte.alias("bytes"))
    return _bound(literals, lambda x: F.transform(words, lambda w: folded(w, x["maps"], x["bytes"])))


def _unreachable(ranks: dict[bytes, int]) -> list[bytes]:
    """Entries that merges don't reach; a vocabulary that was made by merges has none."""
    return [b for b, i in ranks.items() if len(b) > 1 and not any(b[:k] in ranks and b[k:] in ranks and max(ranks[b[:k]], ranks[b[k:]]) < i for k in range(1, len(b)))]


def dictionary(docs: DataFrame, text_col: str, ranks: dict[bytes, int], pattern: str, most: int = DICTIONARY) -> tuple[pa.Array, bytes, np.ndarray]:
    """Words that a task finds twice in runs that it finds twice (if over `most`, the most frequent of them); their ids as 16-bit integers, and where each word's end.

    Results don't depend on the choice: tasks fold the words outside.
    """

    def count(batches):
        find, held = compiled(pattern).findall, collections.Counter()

        def flush():
            words = collections.Counter()
            for run, n in held.items():
                if n > 1:
                    for w in find(run):
                        words[w] += n
            held.clear()
            got = [w for w in words if 4 * len(w) <= LONGEST or len(w.encode()) <= LONGEST]
            return pa.RecordBatch.from_arrays([pa.array(got, pa.string()), pa.array([words[w] for w in got], pa.int64())], ["word", "n"])

        for b in batches:
            for at in range(0, b.num_rows, 1_000):
                for t in b.column(0).slice(at, 1_000).to_pylist():
                    if t:
                        held.update(words_of(t))
                if len(held) > COUNTED:
                    yield flush()
        yield flush()

    counts = docs.select(column(text_col).alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = most_counted(saved(counts, "words"), "n", most)
    counts = counts.select("word", rank_map(ranks).alias("maps"))
    got = counts.select("word", F.get(folded_all(F.array("word"), F.col("maps"), ranks), F.lit(0)).alias("ids")).toArrow()
    ids = pa.concat_arrays(got["ids"].chunks) if got.num_rows else pa.array([], pa.list_(pa.int32()))
    ends = ids.offsets.to_numpy().astype(np.int64)
    words = pa.concat_arrays(got["word"].chunks) if got.num_rows else pa.array([], pa.string())
    return words, ids.flatten().to_numpy(zero_copy_only=False).astype("<u2").tobytes(), ends - ends[0]


class _Runs(dict):
    """Ids of runs as 16-bit integers, worked out when first asked for; of runs not met lately they are forgotten."""

    def __init__(self, words: pa.Array, raw: bytes, ends: np.ndarray, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        at = (2 * ends).tolist()
        self.known = dict(zip(words.to_pylist(), map(lambda a, z: raw[a:z], at, at[1:]), strict=True))
        self.old, self.fold, self.find = {}, Fold(ranks), compiled(pattern).findall

    def __missing__(self, run: str) -> bytes:
        ids = self.old.get(run) or self.known.get(run)
        if ids is None:
            known = self.known
            ids = b"".join([known.get(w) or array("H", self.fold(w.encode("utf-8", "surrogatepass"))).tobytes() for w in self.find(run)])
        if len(self) >= KEPT // 2:
            self.old = dict(self)
            self.clear()
        if len(run) <= LONGEST:
            self[run] = ids
        return ids


#: The runs of one query at a time: a worker's next tasks use what it has kept.
_WORKER: dict[str, _Runs] = {}


def _encoded(rows: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """rows (text, others) to (others, ids)."""
    sent = rows.sparkSession.sparkContext.broadcast((*dictionary(rows, "text", ranks, pattern), ranks, pattern))
    others = [f for f in rows.schema.fields if f.name != "text"]
    names, key = [f.name for f in others], uuid.uuid4().hex

    def encode(batches):
        if key not in _WORKER:
            _WORKER.clear()
            _WORKER[key] = _Runs(*sent.value)
        ids_of = _WORKER[key].__getitem__
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                raw = [b"".join(map(ids_of, words_of(t))) if t else b"" for t in part.column("text").to_pylist()]
                ends = np.concatenate(([0], np.cumsum([len(x) // 2 for x in raw]))).astype(np.int32)
                values = np.frombuffer(b"".join(raw), dtype="<u2").astype(np.int32)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], [*names, "ids"])

    return rows.mapInArrow(encode, StructType(list(others)).add("ids", ArrayType(IntegerType())))


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None, decode: bool = False) -> DataFrame:
    """(id, n_tokens, ids array<int>) of every whole text.

    Null and empty texts have no ids; repeated rows repeat; an empty table gives no rows. Texts may be of any length. Other columns
    of docs take no part, whatever their names. If the id's column is called as one of ours, ours gets an underscore.

    decode: the ids are decoded too, and must give the text back; otherwise the query fails.
    """
    path, default = default_vocabulary()
    ranks, pattern = load_ranks(ranks_path or path), pattern or default
    if odd := _unreachable(ranks):
        raise ValueError(f"merges don't reach {len(odd)} entries of the vocabulary, such as {odd[0]!r}")
    text = column(text_col)
    check = [F.xxhash64(F.coalesce(text, F.lit(""))).alias("check")] if decode else []
    out = _encoded(docs.select(column(id_col).alias("id"), text.alias("text"), *check), ranks, pattern)
    ids = F.col("ids")
    if decode:
        out = out.withColumn("pieces", _pieces(ranks))
        same = F.xxhash64(_decoded(ids, F.col("pieces")).cast("string")) == F.col("check")
        ids = F.when(same, ids).otherwise(F.raise_error(F.lit("the decoded ids don't give the text back")).cast("array<int>"))
    named = out.select(F.col("id").alias(id_col))
    n_name, ids_name = free_name(named, "n_tokens"), free_name(named, "ids")
    return out.select(F.col("id").alias(id_col), ids.alias("ids_")).select(column(id_col), F.size("ids_").cast("long").alias(n_name), F.col("ids_").alias(ids_name))


def _decoded(ids: Column, pieces: Column) -> Column:
    """The concatenated byte strings of an array of ids. pieces: _pieces(), as a column of its own."""
    return _bound(pieces, lambda p: F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(p, i + 1)), "")))


def _pieces(ranks: dict[bytes, int]) -> Column:
    """The byte string of each id, in hex."""
    of_id = [""] * (max(ranks.values()) + 1)
    for b, i in ranks.items():
        of_id[i] = b.hex()
    return _sent(pa.array([of_id], pa.list_(pa.string())))


def decode_documents(encoded: DataFrame, ids_col: str = "ids", ranks_path: str | None = None) -> DataFrame:
    """encoded with a column decoded (binary): the concatenated byte strings of the ids.

    Null ids give null, no ids the empty string; an id that the vocabulary lacks raises (in ANSI mode). If encoded has
    a column decoded, it stays and ours gets an underscore.
    """
    ranks = load_ranks(ranks_path or default_vocabulary()[0])
    name, pieces = free_name(encoded, "decoded"), free_name(encoded, "__pieces")
    out = encoded.withColumn(pieces, _pieces(ranks))
    return out.withColumn(name, _decoded(column(ids_col), F.col(pieces))).drop(pieces)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of what encode_documents and decode_documents give."""
    out = decode_documents(encode_documents(docs.select(column(id_col).alias("id"), column(text_col).alias("text")), "id"))
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)
    return out.select(F.col("id").alias(id_col), "n_tokens", ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of ids and digests; see encode_documents for nulls, ties and empty tables."""
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
