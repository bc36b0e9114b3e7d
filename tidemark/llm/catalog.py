"""The queries of this subpackage, by name."""

from __future__ import annotations

from .alignment import op13_byte_owner_alignment
from .automaton_dedup import op12_suffix_automata
from .bilinear_lm import op3_log_bilinear_lm
from .fmindex import op5_fm_index_decontamination
from .hilbert import op8_hilbert_sharding
from .lexical_search import op11_postings_search
from .minhash import op7_b_bit_minhash
from .oracles import OP5, OP6, OP7, OP11, OP12
from .product_quantiser import op6_product_quantisation
from .pu_quality import op4_pu_quality
from .simple8b import op1_simple8b_ids
from .string_kernel import op10_string_kernel_language
from .suffix_dedup import op2_suffix_array_dedup
from .word_bpe import op9_word_bpe

QUERIES = {f.__name__: f for f in (
    op1_simple8b_ids, op2_suffix_array_dedup, op3_log_bilinear_lm, op4_pu_quality, op5_fm_index_decontamination, op6_product_quantisation, op7_b_bit_minhash, op8_hilbert_sharding, op9_word_bpe, op10_string_kernel_language, op11_postings_search, op12_suffix_automata,
    op13_byte_owner_alignment,
)}

#: DuckDB SQL of those that SQL can express.
ORACLES = {"op5_fm_index_decontamination": OP5, "op6_product_quantisation": OP6, "op7_b_bit_minhash": OP7, "op11_postings_search": OP11, "op12_suffix_automata": OP12}
