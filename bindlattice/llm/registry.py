"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from bindlattice.llm.chat_format import OP9_SQL, op9_chat_format
from bindlattice.llm.decontaminate import OP7_SQL, op7_decontamination
from bindlattice.llm.fill_middle import OP12_SQL, op12_fill_middle
from bindlattice.llm.html_extract import op1_html_extraction
from bindlattice.llm.lm_score import op10_lm_scoring
from bindlattice.llm.mixing import op4_mixing
from bindlattice.llm.near_dedup import op5_near_dedup
from bindlattice.llm.quality import op2_quality
from bindlattice.llm.token_files import op6_token_files
from bindlattice.llm.topk_search import OP3_SQL, op3_exact_top_k
from bindlattice.llm.toxicity import op8_toxicity
from bindlattice.llm.vector_codes import OP11_SQL, op11_vector_codes
from bindlattice.llm.warc_store import OP13_SQL, op13_warc

QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_quality": op2_quality,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_mixing": op4_mixing,
    "op5_near_dedup": op5_near_dedup,
    "op6_token_files": op6_token_files,
    "op7_decontamination": op7_decontamination,
    "op8_toxicity": op8_toxicity,
    "op9_chat_format": op9_chat_format,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_vector_codes": op11_vector_codes,
    "op12_fill_middle": op12_fill_middle,
    "op13_warc": op13_warc,
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_top_k": OP3_SQL,
    "op7_decontamination": OP7_SQL,
    "op9_chat_format": OP9_SQL,
    "op11_vector_codes": OP11_SQL,
    "op12_fill_middle": OP12_SQL,
    "op13_warc": OP13_SQL,
}
