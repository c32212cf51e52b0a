"""Alignment against both libraries over whole texts, with and without a dictionary, and on awkward inputs."""

import collections
import hashlib
import itertools
import os
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from seqloom.llm import alignment as A

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
AWKWARD = [
    None, "", " ", "  ", "\n", " \n ", "a", "a b", " a", "a ", "a  b", "a\nb", "a\n\nb", "a\n b", "a \nb", "\tx\t y", "x 　 y", "x　y", "x\xa0 y z", "it's, isn't it? 'tis.", "end.) (next", "1234567890 12.5%", "e.g., U.S.A.!",
    "<|endoftext|> and <s> </s> <unk> <0x0A>", "under▁line", "▁", "a\x01b c\nd", "a\x00b \x00", "漢字かな交じり文、です。 éèê ñandú Ørsted straße", "😀😀 👩‍👩‍👧", "﻿bom", "é combining", "w" * 3000 + " " + "9" * 500, "=" * 200 + "\n" + "-" * 100,
    "\r\nline\r\nline \r\n", "word." * 30, " " * 40 + "x", "x" + " " * 17, "٣٤ १", "....a ,b ;c", "ſﬁ ŉ, ǆ.", "\x7f\x80 ​ ‍.",
]


def texts(n=40, seed=4):
    rnd = random.Random(seed)
    words = ["the", "The", "tion", "Haus", "straße", "ñezll", "ciónga", "42", "x1", "été", "I'm", "漢字", "zqxj", "unbelievable", "misalignments"]
    return [(rnd.choice(["", " "])).join(rnd.choice(words) + rnd.choice([" ", ", ", ". ", "\n", "  ", "", "!)\n\n"]) for _ in range(rnd.randint(1, 60))) for _ in range(n)]


def brute(docs):
    """The contract's columns by whole-text encodings and plain loops."""
    both = A.Tokenizers(*PATHS)
    rows = []
    for t in docs:
        a, b, groups = [], [], []
        if t:
            a, b = both.a.encode(" " + t, add_special_tokens=False).ids, both.b.encode(t)
            x, y = [both.a_bytes[i] for i in a], [both.b_bytes[i] for i in b]
            if not b"".join(x) == b"".join(y) == (" " + t).encode():
                a, b = [], []
            else:
                place = lambda parts: list(itertools.accumulate(map(len, parts)))
                ea, eb = place(x), place(y)
                cuts = sorted(set(ea) & set(eb))
                groups = [([i for i, e in zip(a, ea, strict=True) if lo < e <= hi], [i for i, e in zip(b, eb, strict=True) if lo < e <= hi]) for lo, hi in zip([0, *cuts], cuts)]  # noqa: B905
        rows.append((a, b, groups))
    count = collections.Counter(p for _, _, groups in rows for p in {(i, j) for x, y in groups for i in x for j in y})
    top = collections.defaultdict(int)
    for (i, _), n in count.items():
        top[i] = max(top[i], n)
    out = []
    for a, b, groups in rows:
        links = [(i, j) for x, y in groups for i in x for j in y]
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sha = hashlib.sha256(said.encode()).hexdigest() if a else ""
        out.append((len(a), len(b), len(groups), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), sha, said))
    return out


@pytest.mark.parametrize("dictionary", [0, 40, 10_000])
def test_equals_whole_texts(spark, dictionary):
    docs = AWKWARD + texts() + ["a b", "a b"]
    # Columns with names of ours, and a null id.
    df = spark.createDataFrame([(i or None, t, "x", 5) for i, t in enumerate(docs)], "doc_id long, text string, groups string, k1 long").repartition(5)
    got = {r["id"]: tuple(r)[1:] for r in A.aligned(df, *PATHS, dictionary=dictionary).collect()}
    for i, want in enumerate(brute(docs)):
        assert got[i or None] == want, docs[i]


def test_pieces_join_to_the_text():
    marks = A.Tokenizers(*PATHS).marks
    assert "." in marks and "," in marks
    for t in AWKWARD + texts(200, 9):
        if t is not None:
            assert "".join(A.pieces_of(t, marks)) == " " + t


def test_empty_table_and_texts(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    zeros = (0, 0, 0, 0, 0, 0, "", "")
    assert {tuple(r) for r in A.aligned(df, *PATHS).collect()} == {(1, *zeros), (2, *zeros)}
    assert A.aligned(df.limit(0), *PATHS).count() == 0


def test_groups_of_one_text(spark):
    """Lengths 2, 1, 3 against 3, 1, 2: cuts at 3 and 6."""
    rows = [(7, [1, 2, 3], [2, 1, 3], [4, 5, 6], [3, 1, 2])]
    df = spark.createDataFrame(rows, "sid long, a array<int>, la array<int>, b array<int>, lb array<int>")
    grouped = A.groups(df)
    assert sorted(tuple(r) for r in grouped.collect()) == [(7, 0, [1, 2], [4]), (7, 1, [3], [5, 6])]
    assert sorted(tuple(r) for r in A.links(grouped).collect()) == [(7, 1, 4, 1), (7, 2, 4, 1), (7, 3, 5, 1), (7, 3, 6, 1)]


def test_the_driver_loads_no_tokenizers_and_ships_no_rows(spark, monkeypatch):
    df, want = spark.createDataFrame([(1, "a b, c"), (2, "a b")], "doc_id long, text string"), brute(["a b, c", "a b"])

    real, driver = A.Tokenizers, os.getpid()

    def in_tasks(*paths):
        assert os.getpid() != driver
        return real(*paths)

    def refused(*_, **__):
        raise AssertionError("rows from the driver")

    monkeypatch.setattr(A, "Tokenizers", in_tasks)
    monkeypatch.setattr(type(spark), "createDataFrame", refused)
    assert {r["id"]: tuple(r)[1:] for r in A.aligned(df, *PATHS, dictionary=2).collect()} == dict(enumerate(want, 1))


def test_rare_pieces_in_any_order():
    rare = pa.array([None, [{"pos": 1, "sid": 8, "groups": None}, {"pos": 0, "sid": 9, "groups": "1|2"}], [], [{"pos": 0, "sid": 7, "groups": "3|4"}]])
    for found, ends in ((A._Rare(rare), [0, 0, 2, 2, 3]), (A._Rare(rare.slice(1, 3)), [0, 2, 2, 3])):
        assert found.ends.tolist() == ends and found.sid.tolist() == [9, 8, 7]
        assert found.groups == ["1|2", None, "3|4"] and found.none.tolist() == [False, True, False]


def test_texts_of_equal_lengths_are_aligned_once(spark, monkeypatch):
    """The relational alignment gets a row for each pair of lists of lengths, not for each piece."""
    both, seen, real = A.Tokenizers(*PATHS), [], A.groups
    docs = ["ab cd ef gh", "ij kl, mn op", "a\x01b"]
    pieces = sorted({p for t in docs for p in A.pieces_of(t, both.marks)})
    shapes = {(tuple(la), tuple(lb)) for _, la, _, lb, ok in both.encode(pieces) if ok}
    assert len(shapes) < len(pieces)
    monkeypatch.setattr(A, "groups", lambda df: (seen.append(df.count()), real(df))[1])
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    for most in (A.SHAPES, 0):  # sent to all tasks, or joined by shuffle
        monkeypatch.setattr(A, "SHAPES", most)
        assert {r["id"]: tuple(r)[1:] for r in A.aligned(df, *PATHS).collect()} == dict(enumerate(brute(docs)))
    assert seen == [len(shapes)] * 2


def test_groups_of_many_links_beside_small_ones(spark, monkeypatch):
    docs = ["w" * 300 + " ab", "漢字かな 😀😀", None, "w" * 300]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    for most in (0, 1, 3):
        monkeypatch.setattr(A, "SMALL_GROUP", most)
        assert {r["id"]: tuple(r)[1:] for r in A.aligned(df, *PATHS).collect()} == dict(enumerate(brute(docs)))


def test_words_counted_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(A, "COUNTED", 5)
    docs = texts(30, 6) + [None, "", "  two  runs\n\n"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(2)
    assert {r["id"]: tuple(r)[1:] for r in A.aligned(df, *PATHS, dictionary=40).collect()} == dict(enumerate(brute(docs)))


def test_words_cut_at_once_are_those_of_each_text():
    marks = A.Tokenizers(*PATHS).marks
    docs = AWKWARD + texts(200, 5)
    words, text = A._cut(pa.array(docs, pa.string()))
    assert list(zip(text.tolist(), words.to_pylist(), strict=True)) == [(i, w) for i, t in enumerate(docs) if t for w in A.words_of(t)]
    which, stems, tails = A._marked(words, marks)
    want = [A.parted(w, marks) for w in words.to_pylist()]
    assert which.tolist() == [len(p) == 2 for p in want]
    assert list(zip(stems.to_pylist(), tails.to_pylist(), strict=True)) == [p for p in want if len(p) == 2]
    for none in ([], [None, ""]):
        words, text = A._cut(pa.array(none, pa.string()))
        assert len(words) == len(text) == 0 and not len(A._marked(words, marks)[0])


def test_groups_filled_with_ids():
    a, b, na, nb, ends = (np.array(x) for x in ([1, 2, 3, 7], [4, 5, 6, 8], [2, 1, 1], [1, 2, 1], [2, 3]))
    assert A._filled(a, b, na, nb, ends) == ["1,2|4;3|5,6", "7|8"]
    assert [(c >> 32, c & 0xFFFFFFFF) for c in A._crossed(a, b, na, nb).tolist()] == [(1, 4), (2, 4), (3, 5), (3, 6), (7, 8)]
    none = np.zeros(0, np.int64)
    assert A._filled(none, none, none, none, none) == [] and not len(A._crossed(none, none, none, none))
