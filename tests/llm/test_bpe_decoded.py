"""The pipeline's stage decodes what it encodes."""

import base64

import pytest

from seqloom.llm import bpe


def test_stage_fails_on_ids_that_do_not_give_the_text_back(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "a zebra"), (2, None), (3, "")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] > 0 for r in corpus_pipeline.bpe_stage(spark, docs, "").collect()} == {1: True, 2: False, 3: False}
    path, pattern = bpe.default_vocabulary()
    ranks = bpe.load_ranks(path)
    ranks[b"a"] = ranks[b"b"]
    bad = tmp_path / "bad.tiktoken"
    bad.write_bytes(b"\n".join(base64.b64encode(k) + f" {i}".encode() for k, i in ranks.items()))
    monkeypatch.setattr(bpe, "default_vocabulary", lambda: (str(bad), pattern))
    with pytest.raises(Exception, match="give the text back"):
        corpus_pipeline.bpe_stage(spark, docs, "").collect()
