"""Query results of all documents against libraries, SQL and plain loops, column by column."""

import collections
import hashlib

import duckdb
import numpy as np
import pytest
from test_llm import SF, WORD, tiktoken_encoding

from seqloom.llm import quality, queries


def documents(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_bpe_digests_of_all_documents(spark):
    enc = tiktoken_encoding()
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.QUERIES["op2_bpe"](spark, SF).collect()}
    want = {}
    for i, t in documents(spark).items():
        ids = enc.encode_ordinary(t)
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert got == want


def test_quality_columns_of_all_documents(spark):
    got = {r["doc_id"]: r for r in queries.QUERIES["op5_quality"](spark, SF).collect()}
    trees = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    kept = 0
    for i, t in documents(spark).items():
        w = WORD.findall(t)
        windows = collections.Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        inside = {x for j in range(len(w) - 2) if windows[tuple(w[j : j + 3])] > 1 for x in (j, j + 1, j + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)), i
        assert r["base_failed"] == failed
        assert not (failed and r["kept"])
        if not failed:
            assert r["kept"] == (trees.score(np.array([quality.statistics(t)[1]]))[0] >= quality.KEEP)
            kept += r["kept"]
    assert kept > len(got) / 4


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.SQL[name])
    columns = sorted(want.columns)
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
