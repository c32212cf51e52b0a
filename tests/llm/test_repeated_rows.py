"""Repeated rows, ids and nulls in the stages and in fitting; fixed rules, whatever else a table holds."""

import pytest

from seqloom.llm import quality

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def stage(spark, rows):
    import corpus_pipeline

    return sorted(map(repr, map(tuple, corpus_pipeline.ngram_join_stage(spark, spark.createDataFrame(rows, COLUMNS), "").collect())))


def test_join_stage_keeps_by_rule(spark):
    near = " ".join(f"w{i}" for i in range(60))
    copy = near.replace("w0 ", "other ")
    null = (None, "a text without an id", "en", "a", 5)
    alone = [null, null, (None, None, None, None, None), (7, near, "en", "a", 1), (9, copy, "en", "b", 2), (8, None, "en", None, 0), (6, "", None, "x", None)]
    want = [r for r in alone if r[0] != 9]
    assert stage(spark, alone) == sorted(map(repr, want))
    # Repeats elsewhere change nothing about them. Equal whole rows count once; others of an id and text stay or go together.
    more = [(1, "repeated words here", "en", "a", 1), (1, "repeated words here", "en", "a", 1), (1, "repeated words here", "en", "b", 1), (9, copy, "de", "b", 2)]
    assert stage(spark, alone + more) == sorted(map(repr, want + more[1:3]))
    # An id with several texts isn't compared: both stay, and nobody goes because of them.
    odd = [(3, near, "en", "a", 1), (3, "another text", "en", "a", 1), (3, "another text", "en", "a", 1), (4, None, "en", "a", 1), (4, "", "en", "a", 1)]
    assert stage(spark, alone + odd) == sorted(map(repr, want + odd[:1] + odd[2:]))


@pytest.mark.parametrize("rows", [2, 5])
def test_fit_rows_bound_repeated_ids(spark, monkeypatch, rows):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y, monotone: seen.append((len(x), len(y))))
    docs = [(i % 2, f"text {i} of words") for i in range(100)] + [(i, "more words") for i in range(2, 40)] + [(None, "x")] * 3
    labels = [(i, i % 2, 0) for i in range(40)] * 2 + [(None, 1, 0), (3, None, 0)]
    quality.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), fit_rows=rows)
    assert seen == [(rows, rows)]
    quality.train(spark.createDataFrame(docs[:100], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert seen[-1] == (2, 2)
