"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Byte offsets where tokens of both end cut a text into groups; tokens of a group are linked. The alignment is relational: tokens are
exploded with their positions, cumulative lengths give their ends, an equi-join on (text, end) finds the cuts, a running
count of cuts numbers the groups, and a join on (text, group) makes the links.

Texts are cut first, at places where both tokenizers end a token whatever surrounds them, so that every such place
ends a group, and a text's alignment is that of its pieces in order. Only the tokens' lengths decide where groups end, so that pieces whose
tokens have the same lengths on both sides, in order, are aligned as one text, and each puts its own ids into its groups. Aligned pieces get back to
their texts in two ways: the most frequent ones, a bounded number, are sent to all tasks; the others are joined by shuffle.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.llm.bpe import SPACE
from seqloom.llm.common import column, forget, most_counted, saved, ship, sized, table, tidy

#: Pieces sent to all tasks, at most, and their longest: a fixed bound. Others are joined by shuffle; results don't depend on it.
DICTIONARY = 300_000
LONGEST = 48
#: Distinct words that a task counts, and pairs that it gathers, at a time.
COUNTED, GATHERED = 500_000, 4_000_000
#: Lists of lengths are sent to all tasks up to so many lengths (some 30 MB); more are joined by shuffle.
SHAPES = 1_000_000
#: Written groups that the driver parses at a time.
PARSED = 20_000
#: Bytes of text that a task takes at a time, about; a longer text is taken by itself.
SLICE = 1 << 22

_MARK = "\x01"
_RUN = re.compile(f"([{SPACE}]{{2,}})")
#: Letters and digits behind which marks at a piece's end are cut off, and these marks, as far as the second vocabulary never joins the two.
_ALNUM = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x250)])))
_MARKS = ".,!?;:*#$%&|<>\"')]}"
#: Pieces that are encoded as one text: without white space but one space at their start.
_PLAIN = re.compile(f" ?[^{SPACE}]+\\Z").match
JOINED = 500


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write a byte that isn't printable Latin-1 as the next free character from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _marks(model) -> str:
    """The marks that a sentencepiece model's entries never join to a letter or digit before them; one with entries over the places where texts are cut is refused."""
    # Two characters that no entry has side by side are never merged: between them B's tokens end.
    own = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    if any("\n" in p or any(x != "▁" and y == "▁" for x, y in zip(p, p[1:])) for p in own):  # noqa: B905
        raise ValueError("the second vocabulary has entries over a line feed or the end of a word")
    return "".join(m for m in _MARKS if not any(x in _ALNUM and y == m for p in own for x, y in zip(p, p[1:])))  # noqa: B905


def marks_of(b_path: str) -> str:
    """_marks() of a model's file; the driver loads neither tokenizer whole."""
    from sentencepiece import SentencePieceProcessor

    return _marks(SentencePieceProcessor(model_file=b_path))


class Tokenizers:
    """A byte-level tokenizer (A: a file of the tokenizers library) and one of pieces (B: a sentencepiece model), for pieces of texts."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        byte_of = _byte_of_char()
        self.a_bytes = {i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.marks = _marks(self.b)
        # B puts a space before what it encodes: a line feed between keeps that apart.
        self.before = len(self.b.encode("\n"))
        self.ends = self.a.encode("\n", add_special_tokens=False).ids, [self.b.piece_to_id("<0x0A>")]
        size = max(self.a_bytes) + 1
        self.a_sizes = np.array([len(self.a_bytes.get(i, b"")) for i in range(size)], dtype=np.int32)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], dtype=np.int32)

    def encode(self, pieces: list[str]) -> list[tuple[list[int], list[int], list[int], list[int], bool]]:
        """Of each piece A's ids and their lengths in bytes, B's, and whether both give its bytes back."""
        out: list = [None] * len(pieces)
        plain = [i for i, p in enumerate(pieces) if _PLAIN(p)]
        for at in range(0, len(plain), JOINED):
            some = plain[at : at + JOINED]
            for i, got in zip(some, self._joined([pieces[i] for i in some]) or (), strict=False):
                out[i] = got
        rest = [i for i, got in enumerate(out) if got is None]
        a_all = [e.ids for e in self.a.encode_batch([pieces[i] for i in rest], add_special_tokens=False)]
        b_all = self.b.encode(["\n" + pieces[i] for i in rest], num_threads=1)
        for i, a, b in zip(rest, a_all, b_all, strict=True):
            b = b[self.before :]
            raw = pieces[i].encode("utf-8", "surrogatepass")
            x, y = [self.a_bytes[j] for j in a], [self.b_bytes[j] for j in b]
            out[i] = a, list(map(len, x)), b, list(map(len, y)), b"".join(x) == raw == b"".join(y)
        return out

    def _joined(self, pieces: list[str]) -> list | None:
        """encode() of pieces without inner white space, as one text with a line feed between two, where both tokenizers end a token; None if it isn't given back byte for byte."""
        text = "\n".join(pieces)
        raw, sides = text.encode("utf-8", "surrogatepass"), []
        a, b = self.a.encode(text, add_special_tokens=False).ids, self.b.encode("\n" + text)[self.before :]
        for ids, of, sizes, end in ((a, self.a_bytes, self.a_sizes, self.ends[0]), (b, self.b_bytes, self.b_sizes, self.ends[1])):
            found = np.array(ids, dtype=np.int64)
            cuts = np.flatnonzero(found == end[0]) if len(end) == 1 else found[:0]
            if len(cuts) != len(pieces) - 1 or b"".join([of[i] for i in ids]) != raw:
                return None
            lengths = sizes[found].tolist()
            begin, stop = [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)]
            sides.append(([ids[x:y] for x, y in zip(begin, stop, strict=True)], [lengths[x:y] for x, y in zip(begin, stop, strict=True)]))
        return [(*x, *y, True) for x, y in zip(zip(*sides[0], strict=True), zip(*sides[1], strict=True), strict=True)]


def words_of(text: str) -> list[str]:
    """A space and text, cut before a space or line feed behind something else, and around a line feed between two others; joined again they are that."""
    text = " " + text
    if _MARK in text:
        return [text]
    if not _RUN.search(text):
        return list(filter(None, text.replace("\n", _MARK + "\n" + _MARK).replace(" ", _MARK + " ").split(_MARK)))
    out, head = [], ""
    for i, part in enumerate(_RUN.split(text)):
        if i % 2:
            head = part if part[0] in " \n" or not out else out.pop() + part
            continue
        cut = part.replace("\n", _MARK + "\n" + _MARK).replace(" ", _MARK + " ").split(_MARK)
        if head:
            cut[0] = head + cut[0]
            head = ""
        out += cut
    if head:
        out.append(head)
    return list(filter(None, out))


def parted(word: str, marks: str) -> tuple[str, ...]:
    """A word, and apart from it the marks at its end that follow a Latin letter or digit."""
    if word[-1] in marks and _MARK not in word:
        stem = word.rstrip(marks)
        if stem and stem[-1] in _ALNUM:
            return stem, word[len(stem) :]
    return (word,)


def pieces_of(text: str, marks: str) -> list[str]:
    """A space and text, cut where both tokenizers end a token; joined again they are that."""
    return [p for w in words_of(text) for p in parted(w, marks)]


#: What a Python worker keeps for its next tasks.
_WORKER: dict[object, object] = {}


def _kept(key, make):
    if key not in _WORKER:
        for old in [k for k in _WORKER if k[0] == key[0]]:
            del _WORKER[old]
        _WORKER[key] = make()
    return _WORKER[key]


def _slices(batch, name: str = "text"):
    """Parts of a batch of about SLICE bytes of text."""
    at = np.cumsum(pc.binary_length(batch.column(name)).fill_null(0).to_numpy().astype(np.int64)) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)] if len(at) else [0]
    for a, z in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, z - a)


def _strings(found: pa.Array) -> list[str | None]:
    """to_pylist() of strings, in a fraction of its time."""
    return found.to_numpy(zero_copy_only=False).tolist()


def _cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words_of() all texts, one text's behind another's, and the place of each one's text. Null and empty texts have none."""
    texts = texts.cast(pa.string())
    empty = pc.equal(pc.binary_length(texts).fill_null(0), 0)
    texts = pc.if_else(empty, "", pc.binary_join_element_wise(" ", texts, ""))
    # Texts with runs of white space or the mark are cut one by one.
    odd = pc.or_(pc.match_substring_regex(texts, _RUN.pattern), pc.match_substring(texts, _MARK))
    plain = pc.replace_substring(pc.replace_substring(pc.if_else(odd, "", texts), "\n", f"{_MARK}\n{_MARK}"), " ", f"{_MARK} ")
    cut = pc.split_pattern(plain, _MARK)
    words, text = cut.flatten(), np.repeat(np.arange(len(cut)), cut.value_lengths().to_numpy())
    there = pc.greater(pc.binary_length(words), 0)
    words, text = words.filter(there), text[there.to_numpy(zero_copy_only=False)]
    if places := np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
        more = [words_of(t[1:]) for t in texts.take(pa.array(places)).to_pylist()]
        text = np.concatenate((text, np.repeat(places, [len(x) for x in more])))
        by = np.argsort(text, kind="stable")
        words, text = pa.concat_arrays([words, pa.array([w for x in more for w in x], pa.string())]).take(pa.array(by)), text[by]
    return words, text


def _marked(words: pa.Array, marks: str) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Which words parted() cuts in two, and both parts of these."""
    if not marks:
        return np.zeros(len(words), bool), words[:0], words[:0]
    stem, tail = f"[{''.join(sorted(_ALNUM))}]", f"[{''.join(map(re.escape, marks))}]+"
    which = pc.and_not(pc.match_substring_regex(words, rf"{stem}{tail}\z"), pc.match_substring(words, _MARK))
    both = pc.extract_regex(words.filter(which), rf"(?s)\A(?P<stem>.*{stem})(?P<tail>{tail})\z")
    return which.to_numpy(zero_copy_only=False), both.field("stem"), both.field("tail")


def _summed(counts: list[tuple[pa.Array, pa.Array]]) -> tuple[pa.Array, pa.Array]:
    """Different strings and the sums of their numbers."""
    both = pa.table([pa.chunked_array([x for x, _ in counts], pa.string()), pa.chunked_array([n for _, n in counts], pa.int64())], ["piece", "n"])
    both = both.group_by("piece", use_threads=False).aggregate([("n", "sum")]).combine_chunks()
    return tuple(pa.concat_arrays(both[c].chunks) if len(both) else pa.array([], both[c].type) for c in ("piece", "n_sum"))


def _encoded(texts: DataFrame, paths: tuple[str, str], marks: str) -> DataFrame:
    """(sid, piece, n, ok, a, la, b, lb): every different piece of the texts, how often it is there, its ids and their lengths."""

    def count(batches):
        held, rows = [], 0

        def flush():
            words, n = _summed(held)
            which, stems, tails = _marked(words, marks)
            which = pa.array(which)
            rest, cut = pc.invert(which), n.filter(which)
            return pa.RecordBatch.from_arrays(list(_summed([(words.filter(rest), n.filter(rest)), (stems, cut), (tails, cut)])), ["piece", "n"])

        for batch in batches:
            for part in _slices(batch):
                got = pc.value_counts(_cut(part.column("text"))[0])
                held.append((got.field("values"), got.field("counts")))
                rows += len(got)
                if rows >= 2 * COUNTED:
                    held, rows = [_summed(held)], 0
                    rows = len(held[0][0])
                    if rows >= COUNTED:
                        yield flush()
                        held, rows = [], 0
        yield flush()

    def encode(batches):
        both = _kept(("tokenizers", paths), lambda: Tokenizers(*paths))
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                got = list(zip(*both.encode(_strings(part.column("piece"))), strict=True))
                ids = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("piece"), part.column("n"), pa.array(got[4]), *[pa.array(x, ids) for x in got[:4]]], ["piece", "n", "ok", "a", "la", "b", "lb"])

    counts = texts.mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    ids = "array<int>"
    out = counts.mapInArrow(encode, f"piece string, n long, ok boolean, a {ids}, la {ids}, b {ids}, lb {ids}")
    return saved(out.select(F.monotonically_increasing_id().alias("sid"), "*"), "pieces", "zstd")


#: Links of a group that is joined within its row; larger groups count equal ids before their sides are joined.
SMALL_GROUP = 1_024


def groups(encoded: DataFrame) -> DataFrame:
    """(sid, g, a, b): the groups of each text, numbered from 0, with both sides' ids in order. encoded: sid, a, la, b, lb (ids and lengths in bytes).

    Both sides of a text must cover the same bytes; then the last group ends with it. Rows are partitioned by text before they are exploded, for windows and join alike.
    """
    by_place = Window.partitionBy("sid").orderBy("pos")

    def side(ids: str, lengths: str) -> DataFrame:
        rows = encoded.select("sid", F.arrays_zip(F.col(ids).alias("id"), F.col(lengths).alias("len")).alias("tokens")).repartition("sid")
        rows = rows.select("sid", F.posexplode("tokens").alias("pos", "t"))
        return rows.select("sid", F.sum("t.len").over(by_place).cast("int").alias("end"), F.col("t.id").alias(f"{ids}_id"))

    ends = side("a", "la").join(side("b", "lb"), ["sid", "end"], "full")
    cut = (F.col("a_id").isNotNull() & F.col("b_id").isNotNull()).cast("int")
    before = Window.partitionBy("sid").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    numbered = ends.withColumn("g", F.coalesce(F.sum(cut).over(before), F.lit(0)))

    def listed(c: str):
        return F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("end", c)))), lambda x: x[c])

    return numbered.groupBy("sid", "g").agg(listed("a_id").alias("a"), listed("b_id").alias("b"))


def _linked(grouped: DataFrame) -> DataFrame:
    """(sid, a, b, n): pairs of ids that are linked in a group of a text, n times; a pair may have several rows."""
    size = F.size("a").cast("long") * F.size("b")
    small = grouped.where(size <= SMALL_GROUP).select("sid", F.explode("a").alias("a"), "b").select("sid", "a", F.explode("b").alias("b"), F.lit(1).cast("long").alias("n"))
    large = grouped.where(size > SMALL_GROUP)
    one = lambda c: large.select("sid", "g", F.explode(c).alias(c)).groupBy("sid", "g", c).agg(F.count("*").alias(f"n_{c}"))
    return small.unionByName(one("a").join(one("b"), ["sid", "g"]).select("sid", "a", "b", (F.col("n_a") * F.col("n_b")).alias("n")))


def links(grouped: DataFrame) -> DataFrame:
    """(sid, a, b, n): how often each pair of ids is linked in each text."""
    return _linked(grouped).groupBy("sid", "a", "b").agg(F.sum("n").alias("n"))


def _shapes(encoded: DataFrame) -> DataFrame:
    """(la, lb, na, nb): of all different lengths of both sides' tokens, how many tokens of each side the groups have, in order."""
    lengths = saved(encoded.where("ok").select("la", "lb").distinct().select(F.monotonically_increasing_id().alias("sid"), "la", "lb"), "lengths", "zstd")
    place = lambda c: F.transform(c, lambda _, i: i)
    grouped = groups(lengths.select("sid", place("la").alias("a"), "la", place("lb").alias("b"), "lb"))
    sizes = grouped.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("g", F.size("a").alias("na"), F.size("b").alias("nb")))).alias("sizes"))
    out = saved(lengths.join(sizes, "sid").select("la", "lb", F.col("sizes.na").alias("na"), F.col("sizes.nb").alias("nb")), "shapes", "zstd")
    forget(lengths)
    return out


def _filled(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, ends: np.ndarray) -> list[str]:
    """The groups of texts as a1,a2|b1;a3|b2,b3. a, b: ids of all texts; na, nb: how many of them each group has; ends: where each text's groups end."""
    start = np.cumsum(na + nb) - na - nb
    ids, sign = np.empty(len(a) + len(b), dtype=np.int64), np.zeros(len(a) + len(b), dtype=np.int8)
    ids[_ranges(start, na)], ids[_ranges(start + na, nb)] = a, b
    sign[start + na - 1] = 1
    sign[start + na + nb - 1] = 2
    sign[(start + na + nb - 1)[ends - 1]] = 3
    said = [""] * (2 * len(ids))
    said[::2], said[1::2] = map(str, ids.tolist()), map(",|;\n".__getitem__, sign.tolist())
    return "".join(said)[:-1].split("\n") if len(ends) else []


def _crossed(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The code (a * 2**32 + b) of each link of groups."""
    first, times = np.repeat(np.cumsum(nb) - nb, na), np.repeat(nb, na)
    return np.repeat(a, times) << 32 | b[_ranges(first, times)]


def _written(encoded: DataFrame, shapes: DataFrame) -> DataFrame:
    """(sid, piece, n, n_a, n_b, n_groups, n_links, groups, codes, large): numbers of each text, its groups as a1,a2|b1;a3|b2,b3, and the codes of its links; null for one that isn't ok.

    large: some group has more than SMALL_GROUP links; then there are no codes.
    """
    few = (shapes.agg(F.sum(F.size("la") + F.size("lb"))).first()[0] or 0) <= SHAPES
    most = SMALL_GROUP

    def write(batches):
        for part in _batches(batches, 10_000):
            fine = pc.and_(part.column("ok"), part.column("na").is_valid())
            rows, fine = part.filter(fine), fine.to_numpy(zero_copy_only=False)
            a, b, na, nb = (rows.column(c).flatten().to_numpy().astype(np.int64) for c in ("a", "b", "na", "nb"))
            size = rows.column("na").value_lengths().to_numpy()
            ends = np.cumsum(size)
            sums = [np.add.reduceat(x, ends - size) if len(ends) else na for x in (na, nb, np.ones(len(na), np.int64), na * nb)]
            large = np.maximum.reduceat(na * nb, ends - size) > most if len(ends) else np.zeros(0, bool)
            small = np.repeat(~large, size)
            codes = _crossed(a[np.repeat(small, na)], b[np.repeat(small, nb)], na[small], nb[small])
            stops = np.concatenate(([0], np.cumsum(np.where(large, 0, sums[3]))))
            columns = [*map(pa.array, sums), pa.array(_filled(a, b, na, nb, ends), pa.string()), pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(codes)), pa.array(large)]
            place = pa.array(np.cumsum(fine) - 1, mask=~fine)
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names[:3]], *[c.take(place) for c in columns]], names)

    names = ["sid", "piece", "n", "n_a", "n_b", "n_groups", "n_links", "groups", "codes", "large"]
    rows = encoded.join(F.broadcast(shapes) if few else shapes, ["la", "lb"], "left").select("sid", "piece", "n", "ok", "a", "b", "na", "nb")
    return rows.mapInArrow(write, "sid long, piece string, n long, n_a long, n_b long, n_groups long, n_links long, groups string, codes array<long>, large boolean")


def _again(written: DataFrame) -> DataFrame:
    """(sid, g, a, b) of what _written() says."""
    ids = lambda x: F.split(x, ",").cast("array<int>")
    rows = written.where("groups IS NOT NULL").select("sid", F.posexplode(F.split("groups", ";")).alias("g", "said"))
    return rows.select("sid", "g", ids(F.substring_index("said", "|", 1)).alias("a"), ids(F.substring_index("said", "|", -1)).alias("b"))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] numbers), start[1], ..."""
    return np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())


_TO_SPACE = bytes.maketrans(b",|;\n", b"    ")


def _parsed(said: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of written groups: the text and the code (a * 2**32 + b) of each link, and of each text (n_a, n_b, n_groups, n_links)."""
    if not said:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 4), np.int64)
    raw = "\n".join(said).encode()
    ids = np.fromstring(raw.translate(_TO_SPACE), dtype=np.int64, sep=" ")
    mark = np.frombuffer(raw, dtype=np.uint8)
    mark = mark[(mark < 48) | (mark > 57)]  # the sign between each two ids
    new_text = mark == 10
    text, group = (np.concatenate(([0], np.cumsum(x))) for x in (new_text, new_text | (mark == 59)))
    of_b = np.concatenate(([0], np.cumsum(mark == 124))) > group
    text_of = text[np.concatenate(([True], group[1:] != group[:-1]))]
    n_a, n_b = np.bincount(group[~of_b], minlength=len(text_of)), np.bincount(group[of_b], minlength=len(text_of))
    a, b, g = ids[~of_b], ids[of_b], group[~of_b]
    first_b = np.concatenate(([0], np.cumsum(n_b)[:-1]))
    codes = np.repeat(a, n_b[g]) << 32 | b[_ranges(first_b[g], n_b[g])]
    sums = [np.bincount(text_of, x, len(said)).astype(np.int64) for x in (n_a, n_b, np.ones(len(text_of)), n_a * n_b)]
    return np.repeat(text_of[g], n_b[g]), codes, np.stack(sums, axis=1)


class _Known:
    """The dictionary: groups of the frequent pieces (null: a tokenizer doesn't give it back), and the numbers of their linked pairs, those of piece i in pairs[ends[i]:ends[i + 1]]."""

    def __init__(self, said: pa.Array):
        self.said, self.fine = said, said.is_valid().to_numpy(zero_copy_only=False)
        pieces, codes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for at in range(0, len(said), PARSED):
            piece, code, _ = _parsed(_strings(said.slice(at, PARSED).drop_null()))
            piece, code = _distinct(piece, code)
            pieces.append((at + np.flatnonzero(self.fine[at : at + PARSED])[piece]).astype(np.int32))
            codes.append(code)
        found = np.concatenate(codes)
        self.codes = np.unique(found)
        self.pairs = np.searchsorted(self.codes, found).astype(np.int32)
        self.ends = np.concatenate(([0], np.cumsum(np.bincount(np.concatenate(pieces), minlength=len(said)))))


def _coded(texts: DataFrame, pieces: pa.ChunkedArray, marks: str) -> DataFrame:
    """(id, codes, rare): each text as numbers of its pieces in the dictionary, or -1 - k for the k-th of its rare ones. Null and empty texts have none."""
    sent, key = texts.sparkSession.sparkContext.broadcast(pieces), uuid.uuid4().hex

    def code(batches):
        index = _kept(("index", key), lambda: dict(zip(_strings(sent.value), range(len(sent.value)), strict=True)))

        def numbers(found: pa.Array) -> np.ndarray:
            return np.fromiter(map(index.get, _strings(found), repeat(-1)), np.int64, len(found))

        for batch in batches:
            for part in _slices(batch):
                words, text = _cut(part.column("text"))
                words = words.dictionary_encode()
                first = numbers(words.dictionary)
                second = np.full(len(first), -1, dtype=np.int64)
                # Words that aren't pieces of the dictionary are parted; what it lacks then is rare.
                lacked = np.flatnonzero(first < 0)
                more = words.dictionary.take(pa.array(lacked))
                which, stems, tails = _marked(more, marks)
                parts = pa.concat_arrays([more.filter(pa.array(~which)), stems, tails]).dictionary_encode()
                own = numbers(parts.dictionary)
                rare = np.flatnonzero(own < 0)
                own[rare] = -1 - np.arange(len(rare))
                said, has_two = own[parts.indices.to_numpy()], np.zeros(len(first), bool)
                n, has_two[lacked[which]] = len(lacked) - len(stems), True
                first[lacked[~which]], first[lacked[which]], second[lacked[which]] = said[:n], said[n : n + len(stems)], said[n + len(stems) :]

                at = words.indices.to_numpy()
                two = has_two[at]
                size = 1 + two
                codes, text = np.repeat(first[at], size), np.repeat(text, size)
                codes[np.cumsum(size)[two] - 1] = second[at[two]]
                # Each text numbers its own rare pieces.
                few = np.flatnonzero(codes < 0)
                pairs, back = np.unique(text[few] * max(1, len(rare)) - 1 - codes[few], return_inverse=True)
                of, piece = np.divmod(pairs, max(1, len(rare)))
                ends = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=part.num_rows))))
                codes[few] = -1 - (np.arange(len(pairs)) - ends[of])[back]
                stops = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=part.num_rows))))
                listed = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(codes.astype(np.int32)))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts.dictionary.take(pa.array(rare[piece])))
                yield pa.RecordBatch.from_arrays([part.column("id"), listed, lists], ["id", "codes", "rare"])

    return texts.select("id", "text").mapInArrow(code, "id long, codes array<int>, rare array<string>")


class _Rare:
    """The rare pieces of a batch's texts, those of text i in rows ends[i]:ends[i + 1], the k-th at place k: sid, groups (None: there are none) and text."""

    def __init__(self, column: pa.Array):
        size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.ends = np.concatenate(([0], np.cumsum(size)))
        self.text = np.repeat(np.arange(len(size)), size)
        rows = column.flatten()
        pos, sid, groups = (rows.field(c) for c in ("pos", "sid", "groups"))
        by = np.lexsort((pos.to_numpy(), self.text))
        self.sid, self.groups = sid.to_numpy()[by], _strings(groups.take(pa.array(by)))
        self.none = np.array([x is None for x in self.groups], dtype=bool)


def _flat(part) -> tuple[np.ndarray, np.ndarray, _Rare]:
    """Codes of a batch's texts, one behind the other, where each text's end, and its texts' rare pieces."""
    codes = part.column("codes")
    ends = codes.offsets.to_numpy().astype(np.int64)
    return codes.flatten().to_numpy(zero_copy_only=False).astype(np.int64), ends - ends[0], _Rare(part.column("rare"))


def _batches(batches, rows: int = 500):
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _whole(codes: np.ndarray, ends: np.ndarray, rare: _Rare, known: _Known) -> np.ndarray:
    """Which texts both tokenizers give back, and have tokens."""
    bad = np.zeros(len(codes) + 1, dtype=np.int64)
    np.cumsum((codes >= 0) & ~known.fine[np.maximum(codes, 0)] if len(known.fine) else np.zeros(len(codes), bool), out=bad[1:])
    return (ends[1:] > ends[:-1]) & (bad[ends[1:]] == bad[ends[:-1]]) & (np.bincount(rare.text[rare.none], minlength=len(ends) - 1) == 0)


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs (a[i], b[i]), in order."""
    by = np.lexsort((b, a))
    a, b = a[by], b[by]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _pair_counts(work: DataFrame, sent) -> DataFrame:
    """(code, n): in how many texts each pair of ids is linked."""

    def gather(batches):
        known = sent.value
        width = len(known.codes)
        count, slot = np.zeros(width, dtype=np.int64), np.zeros(width, dtype=np.int64)
        others = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(others.keys(), pa.int64()), pa.array(others.values(), pa.int64())], ["code", "n"])

        for part in _batches(batches):
            codes, ends, rare = _flat(part)
            fine = _whole(codes, ends, rare, known)
            text = np.repeat(np.arange(len(fine)), np.diff(ends))
            take = fine[text] & (codes >= 0)
            text, piece = text[take], codes[take]
            size = known.ends[piece + 1] - known.ends[piece]
            texts, pairs = [np.repeat(text, size)], [known.pairs[_ranges(known.ends[piece], size)] if len(piece) else known.pairs[:0]]
            own = np.flatnonzero(fine[rare.text])
            if len(own):
                of, found, _ = _parsed([rare.groups[i] for i in own.tolist()])
                row = rare.text[own][of]
                at = np.minimum(np.searchsorted(known.codes, found), max(0, width - 1))
                there = known.codes[at] == found if width else np.zeros(len(found), bool)
                texts.append(row[there])
                pairs.append(at[there])
                # Pairs that the dictionary has nowhere: each once a text.
                others.update(_distinct(row[~there], found[~there])[1].tolist())
            # Each text's pairs count once: of equal ones, that whose place is in the slot.
            text, pair = np.concatenate(texts), np.concatenate(pairs)
            pair = pair[np.argsort(text, kind="stable")] if len(texts) > 1 else pair
            stops = np.cumsum(np.bincount(text, minlength=len(fine))).tolist()
            place = np.arange(len(pair))
            for a, z in zip([0, *stops], stops, strict=False):
                some = pair[a:z]
                slot[some] = place[a:z]
                count[some[slot[some] == place[a:z]]] += 1
            if len(others) >= GATHERED:
                yield flush()
                others = Counter()
        yield flush()
        there = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(known.codes[there]), pa.array(count[there])], ["code", "n"])

    return work.select("codes", "rare").mapInArrow(gather, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _assembled(work: DataFrame, sent, keep_groups: bool) -> DataFrame:
    """(row, id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups, rare): each text's numbers; n_best and count_sum without the pieces of rare (sid and times)."""
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")

    def gather(batches):
        known, numbers = sent.value
        groups, by_number = _strings(known.said), np.ascontiguousarray(numbers.T)
        for part in _batches(batches):
            codes, ends, rare = _flat(part)
            fine = _whole(codes, ends, rare, known)
            text = np.repeat(np.arange(len(fine)), np.diff(ends))
            # A code below 0 stands for a row of rare, whose numbers follow those of the dictionary; its n_best and count_sum come later.
            row = np.where(codes < 0, rare.ends[text] - 1 - codes, 0)
            own = np.flatnonzero(fine[rare.text])
            of_rare = np.zeros((len(rare.sid), 6), dtype=np.int64)
            of_rare[own, :4] = _parsed([rare.groups[i] for i in own.tolist()])[2]
            at_ = np.where(codes >= 0, codes, len(numbers) + row)
            total = np.zeros((len(fine), 6), dtype=np.int64)
            sums = np.zeros(len(codes) + 1, dtype=np.int64)
            for i in range(6):
                np.cumsum(np.concatenate((by_number[i], of_rare[:, i]))[at_], out=sums[1:])
                total[:, i] = np.where(fine, sums[ends[1:]] - sums[ends[:-1]], 0)
            sha, said = [""] * len(fine), ["" if keep_groups else None] * len(fine)
            for i in np.flatnonzero(fine).tolist():
                # Codes below 0 index from the end.
                few = rare.groups[rare.ends[i] : rare.ends[i + 1]]
                groups += few[::-1]
                joined = ";".join(map(groups.__getitem__, codes[ends[i] : ends[i + 1]].tolist()))
                if few:
                    del groups[-len(few) :]
                sha[i] = hashlib.sha256(joined.encode()).hexdigest()
                if keep_groups:
                    said[i] = joined
            times = np.bincount(row[codes < 0], minlength=len(rare.sid))
            stops = np.concatenate(([0], np.cumsum(np.bincount(rare.text[own], minlength=len(fine)))))
            others = pa.StructArray.from_arrays([pa.array(rare.sid[own]), pa.array(times[own])], ["sid", "times"])
            columns = [part.column("row"), part.column("id"), *[pa.array(np.ascontiguousarray(total[:, i])) for i in range(6)], pa.array(sha, pa.string()), pa.array(said, pa.string()), pa.ListArray.from_arrays(pa.array(stops, pa.int32()), others)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "id", *names, "groups_sha256", "groups", "rare"])

    schema = ", ".join(f"{n} long" for n in ("row", "id", *names)) + ", groups_sha256 string, groups string, rare array<struct<sid:long,times:long>>"
    return work.mapInArrow(gather, schema)


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = True, dictionary: int = DICTIONARY) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups) of every document.

    Both tokenizers encode a space and the text, without special tokens, whose strings are plain text. Tokens of a group are linked, all of A's
    with all of B's. A pair's count: how many documents hold it linked, over all of docs. n_best: links whose count is the
    highest of their A id, ties included; count_sum: the counts of all links, summed. groups: both sides' ids of the groups in order, as
    a1,a2|b1;a3|b2,b3 (null unless keep_groups); groups_sha256: its digest, '' without tokens.

    Null and empty texts, and those that a tokenizer doesn't give back byte for byte, have no tokens: zeros and ''. Repeated rows
    are as many documents; null ids stay null. Other columns of docs take no part, whatever their names. An empty table gives no
    rows. dictionary: how many pieces are sent to all tasks; results don't depend on it.
    """
    ship(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    marks = marks_of(b_path)
    texts = docs.select(column(id_col).cast("long").alias("id"), column(text_col).alias("text"))

    encoded = _encoded(texts.select("text"), (a_path, b_path), marks)
    shapes = _shapes(encoded)
    written = saved(_written(encoded, shapes), "written", "zstd")
    forget(encoded)
    forget(shapes)
    tidy(docs.sparkSession)

    numbers = ("n_a", "n_b", "n_groups", "n_links")
    chosen = most_counted(written.where(F.length("piece") <= LONGEST), "n", dictionary).select("sid", "n", "piece", "groups", *numbers).toArrow()
    chosen = chosen.sort_by([("n", "descending"), ("piece", "ascending")])
    # Which pieces were chosen shows by their number and length.
    often = (F.length("piece") <= LONGEST) & (F.col("n") >= chosen["n"][-1].as_py()) if chosen.num_rows else F.lit(False)
    known = _Known(pa.concat_arrays(chosen["groups"].chunks) if chosen.num_rows else pa.array([], pa.string()))
    pieces, chosen = chosen["piece"], chosen.select(["sid", *numbers])
    sent = context.broadcast(known)
    coded = saved(_coded(texts, pieces, marks).select(F.monotonically_increasing_id().alias("row"), "*"), "coded", "zstd")
    rare = coded.select("row", F.posexplode("rare").alias("pos", "piece")).join(written.select("piece", "sid", "groups"), "piece")
    rare = rare.groupBy("row").agg(F.collect_list(F.struct("pos", "sid", "groups")).alias("rare"))
    work = saved(coded.drop("rare").join(rare, "row", "left"), "work", "zstd")
    forget(coded)
    tidy(docs.sparkSession)

    counts = saved(_pair_counts(work, sent).withColumn("a", F.shiftright("code", 32)), "pairs", "zstd")
    top = counts.groupBy("a").agg(F.max("n").alias("top"))  # a row an entry of A's vocabulary
    pairs = counts.join(sized(top), "a").select("code", "n", (F.col("n") == F.col("top")).alias("best"))
    # Beside its number, a piece's lowest bit says whether the dictionary has it: the driver takes the sums of those without a join.
    marked = written.select((F.shiftleft("sid", 1) + often.cast("long")).alias("sid"), "groups", "codes", "large")
    large = _linked(_again(marked.where("large"))).select("sid", F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long")).alias("code"), F.col("n").alias("times"))
    linked_code = marked.where("NOT large").select("sid", F.explode("codes").alias("code"), F.lit(1).cast("long").alias("times")).unionByName(large)
    sums = linked_code.join(pairs, "code").groupBy("sid").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    sums = saved(sums.select(F.shiftright("sid", 1).alias("sid"), F.col("sid").bitwiseAND(1).cast("boolean").alias("often"), "n_best", "count_sum"), "sums", "zstd")
    forget(counts)
    forget(written)
    tidy(docs.sparkSession)

    of = np.zeros((chosen.num_rows + 1, 6), dtype=np.int64)
    if chosen.num_rows:
        for i, c in enumerate(numbers):
            of[:-1, i] = chosen[c].fill_null(0).to_numpy()
        got = sums.where("often").select("sid", "n_best", "count_sum").toArrow()
        sids = chosen["sid"].to_numpy()
        order = np.argsort(sids)
        of[order[np.searchsorted(sids, got["sid"].to_numpy(), sorter=order)], 4:] = np.stack((got["n_best"].to_numpy(), got["count_sum"].to_numpy()), axis=1)
    sent = context.broadcast((known, of))
    out = saved(_assembled(work, sent, keep_groups), "aligned", "zstd")
    forget(work)
    more = out.select("row", F.explode("rare").alias("r")).join(sums, F.col("r.sid") == F.col("sid"))
    more = more.groupBy("row").agg(F.sum(F.col("r.times") * F.col("n_best")).alias("more_best"), F.sum(F.col("r.times") * F.col("count_sum")).alias("more_sum"))
    both = out.drop("rare").join(more, "row", "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    return both.select("id", *numbers, plus("n_best", "more_best"), plus("count_sum", "more_sum"), "groups_sha256", "groups")


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, groups and links; see aligned for nulls, ties, repeated rows and empty tables."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return aligned(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), keep_groups=False).drop("groups").withColumnRenamed("id", "doc_id")
