"""Every stage of the pipeline on tables with extra columns named as those of the operators, and on texts that are null, empty or repeated."""

import pytest
from test_clashes import NAMES, SF, frames, rows

import corpus_pipeline

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    return frames(spark, tmp_path_factory.mktemp("wide"), [*NAMES, "repeated", "several", "rows", "least", "most", "component", "gone"])


@pytest.mark.parametrize("name", list(STAGES)[1:])
def test_extra_columns_change_nothing(spark, wide, name):
    docs = {f: spark.read.parquet(f"{f}/documents.parquet") for f in (SF, wide)}
    assert rows(STAGES[name](spark, docs[wide], wide)) == rows(STAGES[name](spark, docs[SF], SF)) != []


@pytest.mark.parametrize("name", list(STAGES))
def test_awkward_rows(spark, name):
    long = "word " * 30_000
    texts = [None, "", " ", "\n\n", "a", "same text here", "same text here", long, long + "x", "漢字" * 2_000]
    table = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*table, table[5], (None, "no id", None, None, None), (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    out = STAGES[name](spark, docs, SF).collect()
    ids = [r["doc_id"] for r in out]
    assert set(ids) <= {None, *range(len(texts))}
    if name == "n-gram Jaccard join":
        assert sorted(i for i in ids if i is not None) == [0, 1, 2, 3, 4, 5, 7, 8, 9] or sorted(i for i in ids if i is not None) == [0, 1, 2, 3, 4, 5, 7, 9]
        assert ids.count(None) == 2
    if name == "byte-level BPE":
        assert len(out) == len(table) + 3
        assert {r["n_tokens"] for r in out if r["doc_id"] in (0, 1)} == {0}
