"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from grainledger.llm.ann import op10_ann
from grainledger.llm.brown_lm import op1_brown_lm
from grainledger.llm.corpus_sql import OP4, OP7, OP9
from grainledger.llm.html_text import op12_html_text
from grainledger.llm.language_id import op2_language_id
from grainledger.llm.minhash import op9_minhash
from grainledger.llm.mixing import op3_mixing
from grainledger.llm.packing import op5_packing
from grainledger.llm.prefix_trie import op11_prefix_trie
from grainledger.llm.quality import op8_quality
from grainledger.llm.structure_repair import op13_structure_repair
from grainledger.llm.substrings import op4_substrings
from grainledger.llm.token_files import op6_token_files
from grainledger.llm.turn_sql import OP11, OP13
from grainledger.llm.vector_dedup import op7_vector_dedup

QUERIES = {
    "op7_vector_dedup": op7_vector_dedup,
    "op8_quality": op8_quality,
    "op10_ann": op10_ann,
    "op1_brown_lm": op1_brown_lm,
    "op4_substrings": op4_substrings,
    "op9_minhash": op9_minhash,
    "op2_language_id": op2_language_id,
    "op3_mixing": op3_mixing,
    "op5_packing": op5_packing,
    "op6_token_files": op6_token_files,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_html_text": op12_html_text,
    "op13_structure_repair": op13_structure_repair,
}

ORACLE_SQL: dict[str, str] = {"op4_substrings": OP4, "op7_vector_dedup": OP7, "op9_minhash": OP9, "op11_prefix_trie": OP11, "op13_structure_repair": OP13}
