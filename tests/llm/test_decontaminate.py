"""Decontamination against brute force, over parts and pieces, and on awkward inputs."""

import hashlib
import random
import re

import pytest

from seqloom.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width):
    """(n_words, hit places, item ids) of each text."""
    grams = {}
    for item, text in items:
        w = words(text)
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if got := grams.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= got
        out.append((len(w), hit, sorted(str(x) for x in found if x is not None)))
    return out


def corpus(seed=3):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["Ñandú", "漢字", "x1"]
    text = lambda n: "".join(rnd.choice(vocabulary) + rnd.choice([" ", ", ", "\n", " - "]) for _ in range(n))
    items = [(i % 17, text(rnd.choice([4, 12, 30]))) for i in range(20)] + [(None, text(15)), (50, None), (51, ""), (52, " .,"), (53, "Word"), (54, text(200))]
    docs = [None, "", "...", "word", "A WORD here", "漢字漢字"]
    for _ in range(60):
        item = rnd.choice(items)[1] or ""
        cut = rnd.randrange(len(item) + 1)
        docs.append(text(rnd.randint(0, 40)) + rnd.choice([item, item[:cut], item.upper(), ""]) + text(rnd.randint(0, 10)))
    return docs + [docs[20], text(4000) + items[3][1] * 3], items


@pytest.mark.parametrize("options", [{}, {"part_bytes": 150, "piece_words": 7}])
@pytest.mark.parametrize("width", [3, 10])
def test_equals_brute_force(spark, width, options):
    docs, items = corpus()
    # Columns with the names of ours, nulls in them too.
    df = spark.createDataFrame([(i, t, None if i % 2 else 1, "y") for i, t in enumerate(docs)], "doc_id long, text string, n_words long, spans string").repartition(3)
    bench = spark.createDataFrame([(k, t, k) for k, t in items], "item_id long, text string, n_hit long")
    got = {r["doc_id"]: r for r in D.scanned(df, bench, width=width, **options).collect()}
    assert len(got) == len(docs)
    for i, (n, hit, found) in enumerate(brute(docs, items, width)):
        r = got[i]
        assert (r["_n_words"], r["n_hit"], r["items"], r["contaminated"]) == (n, len(hit), sorted(found), bool(hit)), docs[i]
        assert (r["text"], r["n_words"], r["spans"]) == (docs[i], None if i % 2 else 1, "y")
        assert sum(len(words(docs[i][s["begin"] : s["end"]])) for s in r["_spans"]) == len(hit)


def test_digests(spark):
    docs, items = corpus(5)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in D.digests(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {i: (n, len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)) for i, (n, hit, found) in enumerate(brute(docs, items, 10))}
    assert got == want


def test_removes_spans_or_documents(spark):
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"Keep this: {item.upper()}! And é that.", "a"), (2, "nothing of it", None), (None, None, "b"), (3, item, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, doc string")
    bench = spark.createDataFrame([("i", item)], "item_id string, text string")
    assert {tuple(r) for r in D.decontaminated(df, bench).collect()} == {(1, "Keep this: ! And é that.", "a"), rows[1], rows[2], (3, "", None)}
    assert {tuple(r) for r in D.decontaminated(df, bench, remove="documents").collect()} == {rows[1], rows[2]}
    with pytest.raises(ValueError):
        D.decontaminated(df, bench, remove="words")


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([("i", "a b")], "item_id string, text string")
    assert D.scanned(df.limit(0), bench).count() == 0
    assert not D.scanned(df, bench.limit(0)).first()["contaminated"]
    assert D.scanned(df, bench).first()["n_hit"] == 2


def test_windows_of_equal_hash_are_told_apart(monkeypatch):
    """Hits are compared word for word: with all hashes equal the result stays."""
    docs, items = corpus(7)
    numbered = [(i, D.normalised(t)) for i, (_, t) in enumerate(items) if t]
    want = [(n, r.tolist(), f) for n, r, f, _ in D.scan(docs, D.windows(numbered, 10))]
    monkeypatch.setattr(D, "window_hashes", lambda h, width: h[: max(0, len(h) - width + 1)] * 0)
    assert [(n, r.tolist(), f) for n, r, f, _ in D.scan(docs, D.windows(numbered, 10))] == want
