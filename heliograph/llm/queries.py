"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .alignment import op13_alignment
from .binary_output import op4_training_order
from .chat_format import op3_chat_format
from .collocation import op11_collocations
from .decontamination import op9_decontamination
from .line_dedup import op10_line_dedup
from .oracle import ORACLE_SQL
from .packing import op5_packing
from .pii import op7_pii
from .quality import op8_ablation, op8_quality
from .simhash import op6_simhash
from .rule_ensemble import op12_quality_classifier
from .token_count import op1_token_counts
from .toxicity import op2_toxicity

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_toxicity": op2_toxicity,
    "op3_chat_format": op3_chat_format,
    "op4_training_order": op4_training_order,
    "op5_packing": op5_packing,
    "op6_simhash": op6_simhash,
    "op7_pii": op7_pii,
    "op8_quality": op8_quality,
    "op8_rule_ablation": op8_ablation,
    "op9_decontamination": op9_decontamination,
    "op10_line_dedup": op10_line_dedup,
    "op11_collocations": op11_collocations,
    "op12_quality_classifier": op12_quality_classifier,
    "op13_alignment": op13_alignment,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
