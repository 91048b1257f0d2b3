"""Queries of the training-data operators, one per operator, and their SQL."""

from __future__ import annotations

from docloom.llm.bayes_join import OP6_SQL, op6_jaccard_join
from docloom.llm.language_id import op5_language_id
from docloom.llm.mixing import OP8_SQL, op8_mixing
from docloom.llm.packing import op9_packing
from docloom.llm.quality_rules import BASE_SQL, op4_quality_rules, quality_base_counts
from docloom.llm.style_tree import OP7_SQL, op7_style_tree
from docloom.llm.tiff import PAYLOAD_SQL, op2_tiff, tiff_payloads
from docloom.llm.token_counts import op10_token_counts
from docloom.llm.token_files import op3_token_files
from docloom.llm.toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_tiff": op2_tiff,
    "op3_token_files": op3_token_files,
    "op4_quality_rules": op4_quality_rules,
    "op5_language_id": op5_language_id,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_style_tree": op7_style_tree,
    "op8_mixing": op8_mixing,
    "op9_packing": op9_packing,
    "op10_token_counts": op10_token_counts,
    "tiff_payloads": tiff_payloads,
    "quality_base_counts": quality_base_counts,
}
ORACLE_SQL: dict[str, str] = {"op6_jaccard_join": OP6_SQL, "op7_style_tree": OP7_SQL, "op8_mixing": OP8_SQL, "tiff_payloads": PAYLOAD_SQL, "quality_base_counts": BASE_SQL}
