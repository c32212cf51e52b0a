"""Token-ID output in a static range asymmetric numeral system.

All documents' ids, each document ended by one end id, form one stream in ascending document order. The
stream is cut into blocks that decode on their own. One table of frequencies, counted over the whole
stream, serves all blocks. In a block, LANES coders take turns: id i belongs to lane i mod LANES, so a
block is coded and decoded LANES ids at a time. A block has checkpoints (the lanes' states and the
place in the words at every CHECKPOINT turns), from which parts of it can be decoded apart, and a CRC-32
of its ids.

The file format is a folder: `blocks` (block number, first document, ids before it, counts, lane
states, words, checkpoints, crc) and `table` (id, frequency), as Parquet files, which any store
that Spark writes to can hold and whose commits survive lost tasks.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.llm.bpe import _MARK, SPACE, words_of
from seqloom.llm.common import column, forget, saved, shared_folder, sized, table

END = 2
SCALE_BITS = 20
LANES = 2048
CHECKPOINT = 128
#: Ids of a block, about; a document longer than this has a block of its own.
BLOCK = 1 << 20
#: Runs whose ids a Python worker keeps; then it forgets those that it hasn't met lately.
KEPT = 600_000
#: Bytes of text that a Python worker cuts at a time, about; a longer text is cut by itself.
CUT_BYTES = 4 << 20
#: ASCII marks behind a Latin letter or an ASCII digit and up to the run's end are one match of the pattern.
TAIL = r"([A-Za-z0-9\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}])([.,!?;:*#$%&|<>\"')\]}]+)" + _MARK
#: Runs that the library encodes as one text, with a line feed behind each.
JOINED = 500

_PLAIN = re.compile(f" ?[^{SPACE}]+\\Z").match
_LOW = np.uint64(1 << 31)
_32 = np.uint64(32)
_MASK = np.uint64(0xFFFFFFFF)


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies for counts: at least 1 where a count is, summing to 2**SCALE_BITS."""
    total, room = int(counts.sum()), 1 << SCALE_BITS
    freq = np.zeros(len(counts), dtype=np.int64)
    there = counts > 0
    if not total:
        return freq
    freq[there] = np.maximum(1, counts[there].astype(np.float64) * room / total).astype(np.int64)
    over = int(freq.sum()) - room
    for i in np.argsort(-freq, kind="stable"):
        if not over:
            break
        step = min(over, int(freq[i]) - 1) if over > 0 else over
        freq[i] -= step
        over -= step
    if over:
        raise ValueError("too many different ids for the table")
    return freq


class Table:
    """Frequencies by id, and what coding needs of them."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
        self.of_slot = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
        """States, words and checkpoints of a block. Ids are coded from last to first, words stored from first to last."""
        turns = -(-len(ids) // LANES)
        state = np.full(LANES, _LOW, dtype=np.uint64)
        freq, start, top = self.freq[ids], self.start[ids], np.uint64(63 - SCALE_BITS)
        words, marks, n = [], [], 0
        for t in range(turns - 1, -1, -1):
            f = freq[t * LANES : (t + 1) * LANES]
            s = state[: len(f)]
            full = s >= f << top
            if full.any():
                words.append((s[full] & _MASK).astype(np.uint32)[::-1])
                n += len(words[-1])
                s[full] >>= _32
            q = s // f
            s[:] = (q << np.uint64(SCALE_BITS)) + (s - q * f) + start[t * LANES : (t + 1) * LANES]
            if t and t % CHECKPOINT == 0:
                marks.append((t, n, state.copy()))
        stream = np.concatenate(words)[::-1] if words else np.zeros(0, dtype=np.uint32)
        rows = [np.concatenate((np.array([t, n - at], dtype="<u8"), s.astype("<u8"))) for t, at, s in reversed(marks)]
        return state.astype("<u8").tobytes(), stream.astype("<u4").tobytes(), (np.concatenate(rows) if rows else np.zeros(0, dtype="<u8")).tobytes()

    def decode(self, n: int, states: bytes, words: bytes, first: int = 0, last: int | None = None, at: int = 0) -> np.ndarray:
        """Ids of turns first to last of a block of n ids; states and at (words before) are a checkpoint's, or the block's own."""
        state, stream = np.frombuffer(states, dtype="<u8").copy(), np.frombuffer(words, dtype="<u4")
        turns = -(-n // LANES) if last is None else last
        out = np.empty(max(0, min(n, turns * LANES) - first * LANES), dtype=np.uint32)
        low = np.uint64((1 << SCALE_BITS) - 1)
        for t in range(first, turns):
            s = state[: min(LANES, n - t * LANES)]
            slot = s & low
            got = self.of_slot[slot.astype(np.int64)]
            out[(t - first) * LANES : (t - first) * LANES + len(s)] = got
            s[:] = self.freq[got] * (s >> np.uint64(SCALE_BITS)) + slot - self.start[got]
            need = np.flatnonzero(s < _LOW)
            if len(need):
                s[need] = (s[need] << _32) | stream[at : at + len(need)]
                at += len(need)
        return out

    def decode_block(self, n: int, states: bytes, words: bytes, checkpoints: bytes) -> np.ndarray:
        """All ids of a block. The parts between checkpoints are decoded side by side, a turn of all of them at a time; the last part, of fewer turns, by itself."""
        marks = np.frombuffer(checkpoints, dtype="<u8").reshape(-1, LANES + 2)
        if not len(marks):
            return self.decode(n, states, words)
        stream, low = np.frombuffer(words, dtype="<u4"), np.uint64((1 << SCALE_BITS) - 1)
        state = np.vstack((np.frombuffer(states, dtype="<u8"), marks[:-1, 2:]))
        at = np.concatenate(([0], marks[:-1, 1])).astype(np.int64)
        out = np.empty((len(marks), CHECKPOINT, LANES), dtype=np.uint32)
        for t in range(CHECKPOINT):
            slot = state & low
            got = self.of_slot[slot.astype(np.int64)]
            out[:, t] = got
            state = self.freq[got] * (state >> np.uint64(SCALE_BITS)) + slot - self.start[got]
            need = state < _LOW
            counts = need.sum(axis=1)
            places = np.repeat(at - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
            state[need] = (state[need] << _32) | stream[places]
            at += counts
        return np.concatenate((out.reshape(-1), self.decode_part(n, words, checkpoints, len(marks) - 1)))

    def decode_part(self, n: int, words: bytes, checkpoints: bytes, part: int) -> np.ndarray:
        """The ids from checkpoint number part to the next one (or the end): parts of a block decode in parallel."""
        marks = np.frombuffer(checkpoints, dtype="<u8").reshape(-1, LANES + 2)
        last = int(marks[part + 1, 0]) if part + 1 < len(marks) else None
        return self.decode(n, marks[part, 2:].tobytes(), words, int(marks[part, 0]), last, int(marks[part, 1]))


class _Library:
    """The tokenizers library's ids of texts. It encodes each different run once; runs not met lately are forgotten."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = tuple(x.content for x in self.tokenizer.get_added_tokens_decoder().values())
        self.dtype = np.dtype("<u2" if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        self.end = np.array([end_id], dtype=self.dtype).tobytes()
        self.feed = self._ids("\n")
        self.kept: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _look_up(self, runs: set[str]) -> None:
        """Adds the ids of runs to those kept."""
        kept, old = self.kept, self.old
        met = list(filter(old.__contains__, runs))
        kept.update(zip(met, map(old.__getitem__, met), strict=True))
        ask = runs.difference(met)
        # A line feed is a match of its own unless white space other than one space follows.
        plain = list(filter(_PLAIN, ask))
        others = ask.difference(plain) if len(plain) < len(ask) else ()
        joined = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        for some, e in zip(joined, self.tokenizer.encode_batch_fast(["\n".join(some) + "\n" for some in joined], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype=self.dtype)
            ends = np.flatnonzero(ids == np.frombuffer(self.feed, dtype=self.dtype)[0]) if len(self.feed) == self.dtype.itemsize else []
            if len(ends) != len(some):
                kept.update((x, self._ids(x)) for x in some)
                continue
            raw, size, start = ids.tobytes(), self.dtype.itemsize, 0
            for x, end in zip(some, ends.tolist(), strict=True):
                kept[x] = raw[size * start : size * end]
                start = end + 1
        kept.update((x, self._ids(x)) for x in others)

    def _marked(self, texts: pa.Array) -> tuple[pa.Array, list[int]]:
        """texts with a mark between their runs, and the places of those that the library takes whole (empty here)."""
        whole = pc.match_substring(texts, _MARK)
        for x in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, x))
        spaced = pc.and_not(pc.match_substring_regex(texts, f"[{SPACE}]{{2}}"), whole)
        # Without two white-space characters in a row, runs end before spaces and around line feeds.
        out = pc.replace_substring(pc.replace_substring(texts, "\n", f"{_MARK}\n{_MARK}"), " ", f"{_MARK} ")
        out = pc.replace_substring_regex(out, TAIL, rf"\1{_MARK}\2{_MARK}")
        out = pc.if_else(whole, "", out)
        if pc.any(spaced).as_py():
            out = pc.replace_with_mask(out, spaced, pa.array([_MARK.join(words_of(t)) for t in texts.filter(spaced).to_pylist()], pa.large_string()))
        return out, np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist()

    def encode(self, texts) -> list[bytes]:
        """Ids of each text, the end id behind them."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        marked, whole = self._marked(texts)
        cut = pc.split_pattern(marked, _MARK)
        runs = cut.values.dictionary_encode()
        known = runs.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.kept) > KEPT // 2:
            self.kept, self.old = {}, self.kept
        self.kept[""] = b""
        new = set(known).difference(self.kept)
        self._look_up(new)
        # The ids of all runs one after another, and where each text's begin.
        ids = pa.array(list(map(self.kept.__getitem__, known)), pa.large_binary()).take(runs.indices)
        raw = ids.buffers()[2]
        raw = raw.to_pybytes() if raw else b""
        ends = np.frombuffer(ids.buffers()[1], dtype="<i8")[cut.offsets.to_numpy()].tolist()
        out = [raw[i:j] + self.end for i, j in zip(ends, ends[1:], strict=False)]
        for i in whole:
            out[i] = self._ids(texts[i].as_py()) + self.end
        for run in new:
            if len(run) > 1_000:
                del self.kept[run]
        return out


_WORKER: dict[tuple, _Library] = {}


def _library(path: str, end_id: int) -> _Library:
    """One a Python worker: its next tasks use what it has kept."""
    if (path, end_id) not in _WORKER:
        _WORKER.clear()
        _WORKER[path, end_id] = _Library(path, end_id)
    return _WORKER[path, end_id]


def encode_texts(path: str, texts) -> list[bytes]:
    """Ids of each text as little-endian 32-bit integers, as the library encodes it without adding special tokens.

    Texts with a special token's string are given to the library whole, all others run by run; runs end where the
    tokenizer's own pattern ends a match whatever follows. Null is the empty text.
    """
    library = _library(path, 0)
    return [np.frombuffer(x, dtype=library.dtype)[:-1].astype("<u4").tobytes() for x in library.encode([t or "" for t in texts])]


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of all docs to folder, in ascending order of the id, null ids first.

    Null texts are empty ones, of the end id alone. Rows of one id stay together in the order of their texts. An
    empty table gives no block.
    """
    spark = docs.sparkSession

    def tokenize(batches):
        """A row a document, and in the end one of the counts of all ids."""
        library, total = _library(tokenizer_path, end_id), np.zeros(1 << 16, dtype=np.int64)
        for b in batches:
            at = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(), dtype=np.int64) // CUT_BYTES
            edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), b.num_rows] if b.num_rows else []
            for i, j in zip(edges, edges[1:], strict=False):
                part = b.slice(i, j - i)
                raw = library.encode(pc.fill_null(part.column("text").cast(pa.large_string()), ""))
                c = np.bincount(np.frombuffer(b"".join(raw), dtype=library.dtype))
                if len(c) > len(total):
                    c, total = total, c.astype(np.int64)
                total[: len(c)] += c
                n = [len(x) // library.dtype.itemsize for x in raw]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("tie"), pa.array(n, pa.int64()), pa.array(raw, pa.binary()), *(pa.nulls(len(raw), pa.list_(pa.int64())) for _ in range(2))], TOKENS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([at], pa.list_(pa.int64())), pa.array([total[at]], pa.list_(pa.int64()))], TOKENS)

    pure = docs.select(column(id_col).cast("long").alias("id"), F.xxhash64(column(text_col)).alias("tie"), column(text_col).alias("text"))
    TOKENS = ["id", "tie", "n", "ids", "token", "c"]
    tokens = saved(pure.mapInArrow(tokenize, "id long, tie long, n long, ids binary, token array<long>, c array<long>"), "tokens", "zstd")
    wide = _library(tokenizer_path, end_id).dtype

    counts = tokens.where("token IS NOT NULL").selectExpr("inline(arrays_zip(token, c))").groupBy("token").agg(F.sum("c").alias("c")).toPandas()
    size = int(counts["token"].max()) + 1 if len(counts) else 0
    total = np.zeros(size, dtype=np.int64)
    total[counts["token"].to_numpy()] = counts["c"].to_numpy()
    freq = scaled(total)
    there = np.flatnonzero(freq)
    spark.createDataFrame(pd.DataFrame({"token": there.astype(np.int64), "freq": freq[there].astype(np.int64)}), "token long, freq long").coalesce(1).write.parquet(f"{folder}/table")

    shared = spark.sparkContext.broadcast(Table(freq))
    parts = max(1, -(-int(total.sum()) // (BLOCK * 4)))
    ordered = tokens.where("token IS NULL").select("id", "tie", "ids").repartitionByRange(parts, F.col("id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("id").asc_nulls_first(), "tie")
    ordered = ordered.select("id", "ids", F.spark_partition_id().alias("part"))

    def block(part: int, number: int, docs_: list, raw: list) -> pd.DataFrame:
        ids = np.frombuffer(b"".join(raw), dtype=wide)
        states, words, marks = shared.value.encode(ids)
        sizes = [len(x) // wide.itemsize for x in raw]
        row = {"part": part, "number": number, "docs": docs_, "sizes": sizes, "n": len(ids), "crc": zlib.crc32(ids.astype("<u4").tobytes()), "states": states, "words": words, "checkpoints": marks}
        return pd.DataFrame([row])

    def pack(batches):
        held, ids, n, number, part = [], [], 0, 0, 0
        for b in batches:
            for d, raw, part in zip(b.column("id").to_pylist(), b.column("ids"), b.column("part").to_pylist(), strict=True):  # noqa: B007
                held.append(d)
                ids.append(raw.as_py())
                n += len(ids[-1]) // wide.itemsize
                if n >= BLOCK:
                    yield pa.RecordBatch.from_pandas(block(part, number, held, ids), schema=PACKED)
                    held, ids, n, number = [], [], 0, number + 1
        if held:
            yield pa.RecordBatch.from_pandas(block(part, number, held, ids), schema=PACKED)

    PACKED = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("n", pa.int64()), ("crc", pa.int64()), ("states", pa.binary()), ("words", pa.binary()), ("checkpoints", pa.binary())])
    schema = "part int, number int, docs array<long>, sizes array<long>, n long, crc long, states binary, words binary, checkpoints binary"
    ordered.mapInArrow(pack, schema).write.parquet(f"{folder}/blocks")
    forget(tokens)


def _starts(blocks: DataFrame) -> DataFrame:
    """(part, number, start): the ids before each block. Sums run within parts, within groups of parts, and over the few groups."""
    before = lambda c, by, order: F.coalesce(F.sum(c).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = blocks.select("part", "number", "n", F.floor(F.col("part") / 4096).alias("group"))
    parts = per.groupBy("group", "part").agg(F.sum("n").alias("m")).select("group", "part", "m", before("m", "group", "part").alias("p"))
    groups = parts.groupBy("group").agg(F.sum("m").alias("m")).select("group", before("m", F.lit(0), "group").alias("g"))
    parts = parts.join(F.broadcast(groups), "group").select("part", (F.col("p") + F.col("g")).alias("p"))
    return per.select("part", "number", before("n", "part", "number").alias("b")).join(parts, "part").select("part", "number", (F.col("p") + F.col("b")).alias("start"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary of 32-bit integers) from a folder that write() made.

    A block is decoded from all its checkpoints at once. One whose checksum fails raises. A folder without blocks gives no rows.
    """
    blocks = spark.read.parquet(f"{folder}/blocks")
    sizes = spark.read.parquet(f"{folder}/table").toPandas()
    freq = np.zeros(int(sizes["token"].max()) + 1 if len(sizes) else 0, dtype=np.int64)
    freq[sizes["token"].to_numpy()] = sizes["freq"].to_numpy()
    shared = spark.sparkContext.broadcast(Table(freq))
    placed = blocks.join(sized(saved(_starts(blocks), "starts")), ["part", "number"])

    def unpack(batches):
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i] for c in b.schema.names}
                ids = shared.value.decode_block(r["n"].as_py(), r["states"].as_py(), r["words"].as_py(), r["checkpoints"].as_py())
                raw = ids.astype("<u4").tobytes()
                if zlib.crc32(raw) != r["crc"].as_py():
                    raise ValueError(f"block {r['part']}-{r['number']}: its ids don't match their checksum")
                n = r["sizes"].values.to_numpy()
                end = np.cumsum(n)
                ids_ = pa.array([raw[4 * (z - k) : 4 * z] for k, z in zip(n.tolist(), end.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([r["docs"].values, pa.array(r["start"].as_py() + end - n), pa.array(n), ids_], ["doc_id", "start", "n_tokens", "ids"])

    return placed.select("part", "number", "start", "n", "crc", "docs", "sizes", "states", "words", "checkpoints").mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids binary")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, number of ids and checksum, from the files; see write and read for nulls, ties and empty tables."""
    import public_tokenizers

    folder = shared_folder(spark, "rans")
    write(table(spark, sf_dir, "documents").select("doc_id", "text"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
