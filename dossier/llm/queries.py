"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from dossier.llm.chat import OP5_SQL, op5_chat_format
from dossier.llm.extraction import op8_html_extraction
from dossier.llm.lines import OP3_SQL, op3_line_dedup
from dossier.llm.mixing import OP7_SQL, op7_mixing
from dossier.llm.packing import op6_packing
from dossier.llm.quality import OP9_SQL, op9_quality_rules
from dossier.llm.simhash import op2_simhash
from dossier.llm.substrings import OP4_SQL, op4_substring_dedup
from dossier.llm.tokens import op1_token_counts
from dossier.llm.topk import OP10_SQL, op10_top_k

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_simhash": op2_simhash,
    "op3_line_dedup": op3_line_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_chat_format": op5_chat_format,
    "op6_packing": op6_packing,
    "op7_mixing": op7_mixing,
    "op8_html_extraction": op8_html_extraction,
    "op9_quality_rules": op9_quality_rules,
    "op10_top_k": op10_top_k,
}
SQL: dict[str, str] = {
    "op3_line_dedup": OP3_SQL,
    "op4_substring_dedup": OP4_SQL,
    "op5_chat_format": OP5_SQL,
    "op7_mixing": OP7_SQL,
    "op9_quality_rules": OP9_SQL,
    "op10_top_k": OP10_SQL,
}
