"""The registered queries of the training-data operators."""

from __future__ import annotations

from tonetape.llm.byte_bpe import op9_byte_bpe
from tonetape.llm.filter_audit import op12_filter_audit
from tonetape.llm.fingerprints import op10_fingerprints
from tonetape.llm.language import op8_language
from tonetape.llm.line_dedup import op3_line_dedup
from tonetape.llm.maximal_repeats import op13_maximal_repeats
from tonetape.llm.mixing import op1_mix
from tonetape.llm.near_dedup import op6_near_dedup
from tonetape.llm.quality import op7_quality
from tonetape.llm.substring_dedup import op5_substring_dedup
from tonetape.llm.token_counts import op2_token_counts
from tonetape.llm.token_files import op4_token_files
from tonetape.llm.whitening import op11_whitening

QUERIES = {
    "op1_mix": op1_mix,
    "op2_token_counts": op2_token_counts,
    "op3_line_dedup": op3_line_dedup,
    "op4_token_files": op4_token_files,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_near_dedup": op6_near_dedup,
    "op7_quality": op7_quality,
    "op8_language": op8_language,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_fingerprints": op10_fingerprints,
    "op11_whitening": op11_whitening,
    "op12_filter_audit": op12_filter_audit,
    "op13_maximal_repeats": op13_maximal_repeats,
}
