"""Extra columns named as those of the operators change nothing; nor do empty tables crash."""

import pytest

from seqloom.llm import queries

SF = "/root/testdata/sf0.001"
#: Output and internal names.
NAMES = "size source_size target copies taken n_words kept base_failed quality_score n_tokens ids decoded host path rule verdict n_shingles component_id __gone __row __lines __dropped __id __url __copy id n".split()


def frames(spark, folder, extra, empty=False):
    for t in ("documents", "pages", "embeddings", "labels"):
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        for n in extra:
            df = df.withColumn(n, (df[df.columns[0]] * 0 + 7).cast("long"))
        (df.limit(0) if empty else df).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


def rows(df):
    return sorted(repr(tuple(r)) for r in df.select(*sorted(df.columns)).collect())


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    return frames(spark, tmp_path_factory.mktemp("wide"), NAMES)


@pytest.mark.parametrize("name", ["op1_line_dedup", "op2_bpe", "op4_mix_sources", "op5_quality", "op7_url_filter", "op10_ngram_join"])
def test_extra_columns_change_nothing(spark, wide, name):
    assert rows(queries.QUERIES[name](spark, wide)) == rows(queries.QUERIES[name](spark, SF))


def test_quality_stage_ignores_a_column_kept(spark, wide):
    import corpus_pipeline

    stage = corpus_pipeline.quality_stage
    docs = {f: spark.read.parquet(f"{f}/documents.parquet") for f in (SF, wide)}
    assert rows(stage(spark, docs[wide], wide)) == rows(stage(spark, docs[SF], SF)) != []


def test_stages_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, frames(spark, tmp_path, [], empty=True)).count() == 0
