"""Exact repeats of short lines, in the query and in the pipeline's stage, against brute force."""

import random

from test_llm import edit_one

from seqloom.llm import line_dedup

SPACE = " \t\n\v\f\r"


def brute_force(texts):
    """Texts by ascending id, without lines that repeat an earlier one or, from LEAST_CHARS on, are one edit away."""
    seen, out = set(), []
    for t in texts:
        kept = []
        for line in t.split("\n"):
            s = line.strip(SPACE)
            near = len(s) >= line_dedup.LEAST_CHARS and any(edit_one(s, o) for o in seen if len(o) >= line_dedup.LEAST_CHARS)
            if not s or s not in seen and not near:
                kept.append(line)
            if s:
                seen.add(s)
        out.append("\n".join(kept))
    return out


def test_short_lines_equal_brute_force(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(6)
    lines = ["Menu", "menu", "Mena", "x", "y", "", "  ", "\tMenu ", "é", "n" * 18, "n" * 19, "n" * 20, "n" * 21, "A line of more than twenty characters."]
    texts = ["\n".join(rnd.choice(lines) for _ in range(rnd.randint(1, 4))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = dict(enumerate(brute_force(texts)))
    assert {r["doc_id"]: r["text"] for r in line_dedup.op1_line_dedup(spark, str(tmp_path)).collect()} == want
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup_stage(spark, docs, "").collect()}
    assert got == {i: t for i, t in want.items() if t.strip(SPACE) or t == texts[i]}
