"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from seqloom.llm.alignment import op11_align
from seqloom.llm.ann import op8_nearest
from seqloom.llm.bpe import op2_bpe
from seqloom.llm.centroids import OP13_SQL, op13_centroids
from seqloom.llm.decontaminate import OP12_SQL, op12_decontaminate
from seqloom.llm.line_dedup import op1_line_dedup
from seqloom.llm.mixing import OP4_SQL, op4_mix_sources
from seqloom.llm.ngram_join import op10_ngram_join
from seqloom.llm.quality import op5_quality
from seqloom.llm.rans import op3_token_files
from seqloom.llm.sharding import OP9_SQL, op9_shards
from seqloom.llm.urls import OP7_SQL, op7_url_filter
from seqloom.llm.warc import OP6_SQL, op6_warc

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_bpe": op2_bpe,
    "op3_token_files": op3_token_files,
    "op4_mix_sources": op4_mix_sources,
    "op5_quality": op5_quality,
    "op6_warc": op6_warc,
    "op7_url_filter": op7_url_filter,
    "op8_nearest": op8_nearest,
    "op9_shards": op9_shards,
    "op10_ngram_join": op10_ngram_join,
    "op11_align": op11_align,
    "op12_decontaminate": op12_decontaminate,
    "op13_centroids": op13_centroids,
}

SQL = {"op4_mix_sources": OP4_SQL, "op6_warc": OP6_SQL, "op7_url_filter": OP7_SQL, "op9_shards": OP9_SQL, "op12_decontaminate": OP12_SQL, "op13_centroids": OP13_SQL}
