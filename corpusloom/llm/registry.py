"""The queries of this subpackage and the SQL that states their results."""

from __future__ import annotations

from corpusloom.llm.exact_dedup import OP4_SQL, op4_exact_dedup
from corpusloom.llm.language import op13_language
from corpusloom.llm.line_dedup import OP3_SQL, op3_line_dedup
from corpusloom.llm.merkle import OP11_SQL, op11_merkle
from corpusloom.llm.mixing import op8_mixing
from corpusloom.llm.near_dedup import OP1_SQL, op1_near_dedup
from corpusloom.llm.packing import op5_packing
from corpusloom.llm.phrases import OP12_SQL, op12_phrases
from corpusloom.llm.quality import op2_quality
from corpusloom.llm.repetition import OP9_SQL, op9_repetition
from corpusloom.llm.toxicity import op10_toxicity
from corpusloom.llm.urls import OP6_SQL, op6_url_filter
from corpusloom.llm.warc import OP7_SQL, op7_warc

QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_quality": op2_quality,
    "op3_line_dedup": op3_line_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_packing": op5_packing,
    "op6_url_filter": op6_url_filter,
    "op7_warc": op7_warc,
    "op8_mixing": op8_mixing,
    "op9_repetition": op9_repetition,
    "op10_toxicity": op10_toxicity,
    "op11_merkle": op11_merkle,
    "op12_phrases": op12_phrases,
    "op13_language": op13_language,
}
ORACLE = {"op1_near_dedup": OP1_SQL, "op3_line_dedup": OP3_SQL, "op4_exact_dedup": OP4_SQL, "op6_url_filter": OP6_SQL, "op7_warc": OP7_SQL, "op9_repetition": OP9_SQL, "op11_merkle": OP11_SQL, "op12_phrases": OP12_SQL}
