"""The registered corpus queries, and DuckDB statements of those that SQL can express on whole tables; tests hold the others against brute force."""

from __future__ import annotations

from txnlens.llm import collocations, exact_search
from txnlens.llm.bpe import op7_byte_bpe
from txnlens.llm.collocations import op12_collocations
from txnlens.llm.decontaminate import op10_benchmark_decontamination
from txnlens.llm.embedding_dedup import op6_embedding_near_dedup
from txnlens.llm.exact_search import op11_exact_topk
from txnlens.llm.html_extract import op5_html_extraction
from txnlens.llm.language import op2_language_id
from txnlens.llm.quality import op9_quality_classifier
from txnlens.llm.sharding import op8_byte_sharding
from txnlens.llm.simhash import op1_simhash_near_dedup
from txnlens.llm.substring_dedup import op3_substring_dedup
from txnlens.llm.suffix_dedup import op4_suffix_dedup
from txnlens.llm.whitening import op13_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup, op2_language_id, op3_substring_dedup, op4_suffix_dedup, op5_html_extraction, op6_embedding_near_dedup, op7_byte_bpe, op8_byte_sharding,
        op9_quality_classifier, op10_benchmark_decontamination, op11_exact_topk, op12_collocations, op13_whitening,
    )
}

ORACLES = {"op11_exact_topk": exact_search.ORACLE, "op12_collocations": collocations.ORACLE}
