"""The corpus operators against brute force, on small and on awkward inputs."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from seqloom.llm import ann, bpe, line_dedup, mixing, ngram_join, quality, rans, sharding, urls, warc
from seqloom.llm.common import components, shared_folder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
LONG = "word%d " * 1
AWKWARD = [None, "", " ", "\n\n", "a", "a b", "a b c", "The same text twice over here.", "The same text twice over here.", " x  y\t\tz\r\n" * 50, "é漢😀 " * 40, "w" * 5000, "<|endoftext|> in text", "\x01\x1c\x85 odd"]


def awkward(spark, texts=AWKWARD):
    """Documents with nulls in every column, repeated rows, and extra columns whose names clash."""
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else f"s{i % 3}", len(t) if t else None, i, "x") for i, t in enumerate(texts)]
    rows += [rows[7], (None, "no id here at all", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, component_id string")


def empty(spark):
    return awkward(spark).limit(0)


def shingles(text, k):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near_texts(seed=1, families=6, size=9):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(families):
        base = [rnd.choice(words) for _ in range(rnd.choice((6, 40, 120)))]
        for _ in range(size):
            t = list(base)
            for _ in range(rnd.randint(0, 3)):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            out.append(" ".join(t))
    return out


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 80, 100)])
def test_ngram_join_equals_brute_force(spark, k, num, den):
    texts = AWKWARD + near_texts()
    docs = awkward(spark, texts)
    got = {(r["id"], r["n_shingles"], r["_component_id"]) for r in ngram_join.classes(docs, k, num, den).collect()}
    sets = [shingles(t, k) for t in texts]
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and den * both >= num * len(sets[i] | sets[j]):
            a, b = root[i], root[j]
            root = [min(a, b) if x in (a, b) else x for x in root]
    want = {(i, len(s), root[i]) for i, s in enumerate(sets)}
    none = len(shingles("no id here at all", k))
    assert {x for x in got if x[0] is not None} == want
    assert {x[:2] for x in got if x[0] is None} == {(None, none)}
    assert ngram_join.classes(empty(spark), k, num, den).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 90), (90, 95), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert {got[i] for i in range(51)} == {0}
    assert (got[90], got[95], got[100]) == (90, 90, 90)


def edit_one(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def test_line_dedup_equals_brute_force(spark):
    rnd = random.Random(4)
    base = ["".join(rnd.choice("abcdé ") for _ in range(n)) + "." for n in (19, 20, 21, 40, 64, 150, 511, 512, 513, 1300)]
    lines = list(base)
    for b in base:
        for _ in range(6):
            p, kind = rnd.randrange(len(b)), rnd.randrange(4)
            lines.append({0: b[:p] + "Z" + b[p:], 1: b[:p] + b[p + 1 :], 2: b[:p] + "Z" + b[p + 1 :], 3: b[:p] + "ZZ" + b[p:]}[kind])
        lines += [b[1:], b[:-1], b + "!", "!" + b, b + "!!"]
    rnd.shuffle(lines)
    texts = ["\n".join(lines[i : i + 4]) for i in range(0, len(lines), 4)] + [None, "", "\n", "short\nshort", base[5] + "\n  " + base[5] + " "]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, line string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduped(docs).collect()}
    seen, want = [], {}
    for i, t in enumerate(texts):
        kept = []
        for line in [] if t is None else t.split("\n"):
            s = line.strip(" \t\n\v\f\r")
            if len(s) < line_dedup.LEAST_CHARS or not any(edit_one(s, o) for o in seen):
                kept.append(line)
            if len(s) >= line_dedup.LEAST_CHARS:
                seen.append(s)
        want[i] = None if t is None else "\n".join(kept)
    assert got == want
    assert line_dedup.deduped(docs.limit(0)).count() == 0
    assert line_dedup.deduped(awkward(spark)).count() == len(AWKWARD) + 2


def tiktoken_encoding():
    import tiktoken

    path, pattern = bpe.default_vocabulary()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})


def test_bpe_equals_library(spark):
    docs, enc = awkward(spark), tiktoken_encoding()
    got = bpe.decode_documents(bpe.encode_documents(docs)).collect()
    want = collections.Counter((r["doc_id"], tuple(enc.encode_ordinary(r["text"] or ""))) for r in docs.collect())
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert all(bytes(r["decoded"]).decode() == texts[r["doc_id"]] for r in got)
    assert bpe.digests(empty(spark)).count() == 0
    one = {r["doc_id"]: r for r in bpe.digests(docs).collect()}
    assert one[8]["ids_sha256"] == hashlib.sha256(",".join(map(str, enc.encode_ordinary(AWKWARD[8]))).encode()).hexdigest()


def test_bpe_coder_on_random_texts():
    path, pattern = bpe.default_vocabulary()
    coder, enc, rnd = bpe.Coder(bpe.load_ranks(path), pattern), tiktoken_encoding(), random.Random(5)
    letters = [" ", "\n", "\t", "a", "B", "é", "1", "²", "'", "s", "ll", ".", "!?", "\xa0", "\u3000", "\x1c", "\x85", "日本", "😀", "\r", "\x01", "'re", "  "]
    for _ in range(3000):
        t = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 14)))
        ids = coder.encode(t)
        assert [int(x) for x in ids.split(b",") if x] == enc.encode_ordinary(t)
        assert coder.decode(ids) == t.encode()


def test_rans_blocks():
    rnd = np.random.default_rng(2)
    for n in (1, 5, 511, 512, 513, 300_000):
        ids = np.minimum(rnd.geometric(0.01, n), 5000).astype(np.uint32)
        t = rans.Table(rans.scaled(np.bincount(ids, minlength=6000)))
        states, words, marks = t.encode(ids)
        assert (t.decode(n, states, words) == ids).all()
        parts = len(marks) // (8 * (rans.LANES + 2))
        if parts:
            last = np.concatenate([t.decode_part(n, words, marks, p) for p in range(parts)])
            assert (last == ids[rans.CHECKPOINT * rans.LANES :]).all()
    assert len(words) < ids.nbytes / 2


def test_rans_files(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs, folder = awkward(spark), shared_folder(spark, "test-rans")
    path = public_tokenizers.path("byte_bpe_50k.json")
    rans.write(docs, folder, path)
    got = sorted(rans.read(spark, folder).collect(), key=lambda r: r["start"])
    tok, at = Tokenizer.from_file(path), 0
    rows = sorted(docs.collect(), key=lambda r: -1 if r["doc_id"] is None else r["doc_id"])
    for r, want in zip(got, rows, strict=True):
        ids = np.array([*tok.encode(want["text"] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) == (want["doc_id"], at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    folder = shared_folder(spark, "test-rans")
    rans.write(empty(spark), folder, path)
    assert rans.read(spark, folder).count() == 0


def test_mixing(spark):
    docs = awkward(spark)
    rows = mixing.with_copies(docs).collect()
    assert "_size" in mixing.with_copies(docs).columns
    assert sum({r["source"]: r["target"] for r in rows}.values()) == pytest.approx(sum(r["_size"] for r in rows))
    assert all(r["target"] <= 3 * r["source_size"] + 1e-9 and 0 <= r["copies"] <= 3 for r in rows)
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix(docs).count() == sum(r["copies"] for r in rows)
    assert mixing.mix(empty(spark)).count() == 0
    many = spark.createDataFrame([(i, "a b c d", f"s{i % 4}") for i in range(4000)], "doc_id long, text string, source string")
    by = collections.Counter()
    target = {}
    for r in mixing.with_copies(many).collect():
        by[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
    assert all(abs(by[s] - t) < 0.1 * t for s, t in target.items())


def test_quality(spark):
    def counts(t):
        t = t or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        inside = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside)]

    for t in [*AWKWARD, "a b c a b c d", "x\ny\nx\n\nx", *near_texts()]:
        assert quality.statistics(t)[0] == counts(t)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    trees = quality.train(docs, labels.where("doc_id % 4 <> 0"))
    held = {r["doc_id"]: r["quality"] for r in labels.where("doc_id % 4 = 0").collect()}
    got = {r["doc_id"]: r for r in quality.judged(docs, trees).collect()}
    right = [(got[i]["quality_score"] >= 0.5) == (q > 0) for i, q in held.items()]
    assert sum(right) / len(right) >= 0.9
    out = quality.judged(awkward(spark), trees)
    assert out.count() == len(AWKWARD) + 2
    assert quality.judged(empty(spark), trees).count() == 0
    assert quality.train(docs, labels.limit(0)).score(np.zeros((1, len(quality.FEATURES)))).shape == (1,)


def test_trees_are_monotone():
    r = np.random.default_rng(0)
    x = r.random((800, 3))
    y = ((x[:, 0] + 0.3 * r.standard_normal(800)) > 0.5).astype(float)
    t = quality.fit(x, y, (-1, 0, 0))
    grid = np.full((50, 3), 0.5)
    grid[:, 0] = np.linspace(0, 1, 50)
    assert (np.diff(t.score(grid)) <= 1e-12).all()
    t = quality.fit(x, y, (1, 0, 0))
    assert (np.diff(t.score(grid)) >= -1e-12).all()
    assert ((t.score(x) > 0.5) == (y > 0)).mean() > 0.8


def test_line_dedup_of_long_lines(spark):
    """One edit anywhere in a long line is found, two are not, at lengths about the edges of blocks."""
    rng, rows, gone = random.Random(3), [], set()
    for n in (510, 511, 512, 513, 514, 767, 768, 769, 1024, 1025, 1031, 3001):
        for at in (0, 1, n // 2, n - 2, n - 1):
            for edit in ("insert", "delete", "replace", "two"):
                line = "".join(rng.choice("abcdefgh é😀") for _ in range(n - 2))
                line = f"x{line}x"
                other = {"insert": line[:at] + "Q" + line[at:], "delete": line[:at] + line[at + 1 :]}.get(edit, line[:at] + "Q" + line[at + 1 :])
                if edit == "two":
                    other = other[: n // 3] + "RR" + other[n // 3 :]
                rows += [(len(rows), line), (len(rows) + 1, other)]
                # White space around a line is left out: an edit beside it may then be more than one.
                if edit != "two" and len(line) - 1 <= len(other.strip(" ")) <= len(line) + 1:
                    gone.add(len(rows) - 1)
    out = line_dedup.deduped(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in out.where("__dropped > 0").collect()} == gone


def test_warc(spark):
    html = [None, "", "x" * 100, "x" * 100, "y" * 99, "y" * 99, "é" * 50, "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n" + "z" * 200, "WARC/1.1\r\n" * 9]
    pages = spark.createDataFrame([(i, None if i == 1 else f"http://h/{i} a", h) for i, h in enumerate(html)] + [(3, "again", "x" * 100)], "page_id long, url string, html string")
    folder = shared_folder(spark, "test-warc")
    warc.write(pages.repartition(2), folder)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    try:
        got = warc.read(spark, folder).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = collections.Counter()
    for i, h in [*enumerate(html), (3, "x" * 100)]:
        b = (h or "").encode()
        want[(i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if i == 3 else "response", 2 if i == 3 else None)] += 1
    assert collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    folder = shared_folder(spark, "test-warc")
    warc.write(pages.limit(0), folder)
    assert warc.read(spark, folder).count() == 0


def test_urls(spark):
    cases = {
        None: ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "http://A.Net/x?q": ("a.net", "/x", "net/", "block"), "http://a.net": ("a.net", "", None, "allow"),
        "https://b.example.net/en/p#f": ("b.example.net", "/en/p", "example.net/en/", "allow"), "http://example.net/en": ("example.net", "/en", "net/", "block"),
        "http://badexample.com/de/": ("badexample.com", "/de/", None, "allow"), "x://y.example.com/de/1": ("y.example.com", "/de/1", "example.com/de/", "block"),
        "http://www.listed.org/p.html?x": ("www.listed.org", "/p.html", None, "block"), "http://org/fr/a://b": ("org", "/fr/a://b", "org/fr/", "allow"), "http://a#/b": ("a", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(cases)] + [(99, "http://a.net", "x")], "page_id long, url string, host string")
    rules = spark.createDataFrame(list(urls.RULES), "host string, path string, verdict string")
    listed = spark.createDataFrame([("listed.org/p",), ("other.org/q",)], "url string")
    got = urls.judged(pages, rules, listed).collect()
    assert {r["url"]: (r["_host"], r["path"], r["rule"], r["verdict"]) for r in got} == cases
    assert len(got) == len(cases) + 1
    assert urls.judged(pages.limit(0), rules, listed.limit(0)).count() == 0


def test_nearest(spark):
    r = np.random.default_rng(1)
    x = [list(map(float, v)) for v in r.standard_normal((300, 8))]
    rows = [*enumerate(x), (300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [None] * 8), (304, x[0]), (None, x[1]), (5, x[5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for q in sorted(ann.nearest(df, 10).collect(), key=lambda q: (q["query_id"], q["rank"])):
        got[q["query_id"]].append((q["vec_id"], q["score"]))
    ids, m = np.array([*range(300), 304]), np.array([*x, x[0]])
    hits = 0
    for i in range(0, 300, 20):
        s = m @ m[i]
        best = [int(ids[j]) for j in np.lexsort((ids, -s)) if ids[j] != i][:10]
        assert len(got[i]) == 10
        assert all(abs(v - m[list(ids).index(j)] @ m[i]) < 1e-12 for j, v in got[i])
        hits += len(set(best) & {j for j, _ in got[i]})
    assert set(got) == set(range(0, 300, 20))
    assert hits >= 0.9 * 150
    few = ann.nearest(df.where("vec_id < 5"), 20).collect()
    assert len(few) == 4
    assert ann.nearest(df.limit(0)).count() == 0


def test_shards(spark):
    root = shared_folder(spark, "test-shards")
    store = sharding.ShardStore(spark, root)
    for _ in range(6):
        store.append(awkward(spark).repartition(2))
    old = store.manifest()
    assert len(old["shards"]) == 12
    assert store.compact(target=1 << 20) == old["version"] + 1
    assert len(store.manifest()["shards"]) == 1
    n = 6 * (len(AWKWARD) + 2)
    assert store.read().count() == n
    assert store.read(old["version"]).count() == n
    with pytest.raises(RuntimeError, match="another writer"):
        store.commit(old, [], old["schema"])
    assert store.vacuum() == 12
    assert store.versions() == [old["version"] + 1]
    assert store.read().count() == n
    with pytest.raises(ValueError, match="schema"):
        store.append(spark.range(3))
    runs = sharding.ShardStore.runs([{"path": str(i), "bytes": b, "seq": i} for i, b in enumerate([10, 10, 10, 10, 600, 600])], 1000)
    assert [len(r) for r in runs] == [4]


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids"]
    assert out.count() > 0
    docs = awkward(spark).drop("size", "component_id")
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, SF)
    assert docs.count() > 0
