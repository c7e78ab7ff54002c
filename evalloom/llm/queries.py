"""The queries of this package, by name, and the SQL that gives the same rows where there is one."""

from __future__ import annotations

from evalloom.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from evalloom.llm.katz import op10_katz
from evalloom.llm.line_dedup import OP8_SQL, op8_line_dedup
from evalloom.llm.matroska import op6_matroska
from evalloom.llm.packing import op2_packing
from evalloom.llm.secret_scan import OP5_SQL, op5_secret_scan
from evalloom.llm.sentencepiece import op4_sentencepiece
from evalloom.llm.simhash import op3_simhash
from evalloom.llm.suffix_dedup import op9_suffix_dedup
from evalloom.llm.toxicity import op7_toxicity

QUERIES = {"op9_suffix_dedup": op9_suffix_dedup, "op1_exact_dedup": op1_exact_dedup, "op2_packing": op2_packing, "op10_katz": op10_katz, "op3_simhash": op3_simhash, "op4_sentencepiece": op4_sentencepiece, "op5_secret_scan": op5_secret_scan, "op6_matroska": op6_matroska, "op7_toxicity": op7_toxicity, "op8_line_dedup": op8_line_dedup}
ORACLES = {"op1_exact_dedup": OP1_SQL, "op5_secret_scan": OP5_SQL, "op8_line_dedup": OP8_SQL}
