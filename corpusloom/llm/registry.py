"""Queries and DuckDB SQL of this subpackage, for the driver's registry."""

from __future__ import annotations

from .ann import op10_ivfpq
from .bpe import op13_bpe_trie
from .conversations import op12_conversation_repair
from .divergence import SQL_OP11, op11_source_divergence
from .langid import op4_viterbi_langid
from .linededup import op9_line_dedup
from .mixing import op5_hierarchical_mix
from .packing import op6_hilbert_packing
from .pii import op2_deobfuscated_pii
from .quality import SQL_OP1, op1_line_frequency
from .simhash import op3_simhash
from .toxicity import op7_segment_toxicity
from .warc import SQL_OP8, op8_warc_round_trip

QUERIES = {
    "op1_line_frequency": op1_line_frequency,
    "op2_deobfuscated_pii": op2_deobfuscated_pii,
    "op3_simhash": op3_simhash,
    "op4_viterbi_langid": op4_viterbi_langid,
    "op5_hierarchical_mix": op5_hierarchical_mix,
    "op6_hilbert_packing": op6_hilbert_packing,
    "op7_segment_toxicity": op7_segment_toxicity,
    "op8_warc_round_trip": op8_warc_round_trip,
    "op9_line_dedup": op9_line_dedup,
    "op10_ivfpq": op10_ivfpq,
    "op11_source_divergence": op11_source_divergence,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_bpe_trie": op13_bpe_trie,
}

SQL = {
    "op1_line_frequency": SQL_OP1,
    "op8_warc_round_trip": SQL_OP8,
    "op11_source_divergence": SQL_OP11,
}
