"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from .bytepairs import op12_bpe_words
from .decontaminate import op8_decontaminate
from .fuzzylines import op6_fuzzy_lines
from .hardnegatives import OP13_SQL, op13_hard_negatives
from .lexicalblocks import OP11_SQL, op11_block_search
from .licenses import OP3_SQL, op3_license_sentences
from .matroska import op1_matroska
from .mixing import op4_mix_sources
from .ngramjoin import op5_parity_sketch_join
from .quality import op10_quality
from .replytrees import OP7_SQL, op7_format_conversations
from .secrets import op9_secret_ledger
from .sql import OP2_SQL, OP5_SQL, OP8_SQL, OP9_SQL
from .suffixdedup import op2_suffix_dedup

QUERIES = {
    "op1_matroska": op1_matroska,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_license_sentences": op3_license_sentences,
    "op4_mix_sources": op4_mix_sources,
    "op5_parity_sketch_join": op5_parity_sketch_join,
    "op6_fuzzy_lines": op6_fuzzy_lines,
    "op7_format_conversations": op7_format_conversations,
    "op8_decontaminate": op8_decontaminate,
    "op9_secret_ledger": op9_secret_ledger,
    "op10_quality": op10_quality,
    "op11_block_search": op11_block_search,
    "op12_bpe_words": op12_bpe_words,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op2_suffix_dedup": OP2_SQL,
    "op5_parity_sketch_join": OP5_SQL,
    "op8_decontaminate": OP8_SQL,
    "op9_secret_ledger": OP9_SQL,
    "op3_license_sentences": OP3_SQL,
    "op7_format_conversations": OP7_SQL,
    "op11_block_search": OP11_SQL,
    "op13_hard_negatives": OP13_SQL,
}
