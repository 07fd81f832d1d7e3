"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from .chat import OP1_SQL, op1_chat_formatting
from .crf import op8_crf_quality
from .decontaminate import op2_benchmark_decontamination
from .licences import OP10_SQL, op10_licence_scan
from .pieces import op7_sentencepiece_merge_dropout
from .ppm import op5_ppm_scores
from .pseudonyms import op9_pii_pseudonyms
from .rules import op3_quality_rules
from .simhash import op6_simhash_near_dedup
from .tokencache import op4_token_counts


def queries() -> dict:
    every = (op1_chat_formatting, op2_benchmark_decontamination, op3_quality_rules, op4_token_counts, op5_ppm_scores, op6_simhash_near_dedup, op7_sentencepiece_merge_dropout, op8_crf_quality, op9_pii_pseudonyms, op10_licence_scan)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": OP1_SQL, "op10_licence_scan": OP10_SQL}
