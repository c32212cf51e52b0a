"""The rows of each stage of the pipeline, and of run(), against brute force."""

import collections
import itertools

import duckdb
from test_llm import SF, WORD, shingles, tiktoken_encoding
from test_short_lines import SPACE, brute_force

from seqloom.llm import mixing, quality


def good(text, trees):
    """Whether the quality rules keep a text; the trees' score is taken as given."""
    w = WORD.findall(text)
    c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w) >= 50 and 2 * len(inside) <= len(w) and trees.score([quality.statistics(text)[1]])[0] >= quality.KEEP


def leading(docs):
    """docs (id: text) without those whose group of near copies has a smaller id."""
    sets, root = {i: shingles(t, 5) for i, t in docs.items()}, {i: i for i in docs}
    for i, j in itertools.combinations(docs, 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * len(sets[i] | sets[j]):
            a, b = root[i], root[j]
            root = {x: min(a, b) if r in (a, b) else r for x, r in root.items()}
    return {i: t for i, t in docs.items() if root[i] == i}


def fixture(spark, folder):
    """The smallest tables, with near copies of long texts that line dedup leaves: one line each, of another first word."""
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    at = docs.columns.index("text")
    for r in [r for r in rows if r[at] and len(WORD.findall(r[at])) > 150][:9]:
        text = " ".join(["otherfirstword", *WORD.findall(r[at])[1:]])
        more = {"doc_id": r[docs.columns.index("doc_id")] + 100_000, "text": text, "n_chars": len(text)}
        rows.append(tuple(more.get(c, v) for c, v in zip(docs.columns, r, strict=True)))
    spark.createDataFrame(rows, docs.schema).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_rows_of_every_stage_equal_brute_force(spark, tmp_path, monkeypatch):
    import numpy as np

    import corpus_pipeline

    sf = fixture(spark, tmp_path)
    stages, saved = {}, corpus_pipeline.saved

    def keep(df, name):
        out = saved(df, name)
        if df.columns[0] == "doc_id" and name in {n.replace(" ", "-") for n, _ in corpus_pipeline.STAGES}:
            stages[name] = out
        return out

    monkeypatch.setattr(corpus_pipeline, "saved", keep)
    last = corpus_pipeline.run(spark, sf).collect()
    assert len(stages) == len(corpus_pipeline.STAGES)

    documents = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in documents.collect()}
    trees = quality.train(documents, spark.read.parquet(f"{sf}/labels.parquet"))
    score = trees.score
    trees.score = lambda x: score(np.array(x, dtype=np.float64))
    other = lambda i: (rows[i]["lang"], rows[i]["source"])

    def same(name, want, copies=None):
        got = collections.Counter((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in stages[name].collect())
        n_chars = (lambda i, t: rows[i]["n_chars"]) if name == "quality-rules" else (lambda i, t: len(t))
        assert got == collections.Counter({(i, t, *other(i), n_chars(i, t)): (copies or {}).get(i, 1) for i, t in want.items()})

    want = {i: rows[i]["text"] for i in sorted(rows) if good(rows[i]["text"] or "", trees)}
    same("quality-rules", want)
    assert 0 < len(want) < len(rows)

    before = dict(want)
    want = {i: t for i, t in zip(before, brute_force(before.values()), strict=True) if t.strip(SPACE) or t == before[i]}
    same("line-dedup", want)
    assert want != before

    before, want = want, leading(want)
    same("n-gram-Jaccard-join", want)
    assert len(want) < len(before)

    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(i, t, rows[i]["source"]) for i, t in want.items()])
    q = con.sql(mixing.OP4_SQL)
    at = [q.columns.index(c) for c in ("doc_id", "size", "taken")]
    copies = {i: n for i, n in ((r[at[0]], r[at[2]] // r[at[1]]) for r in q.fetchall()) if n}
    want = {i: t for i, t in want.items() if i in copies}
    same("mixing-sources", want, copies)

    enc = tiktoken_encoding()
    ids = {i: tuple(enc.encode_ordinary(t)) for i, t in want.items()}
    expected = collections.Counter({(i, len(x), x): copies[i] for i, x in ids.items()})
    assert collections.Counter((r["doc_id"], r["n_tokens"], tuple(r["ids"])) for r in last) == expected
    assert list(stages)[-1] == "byte-level-BPE"
