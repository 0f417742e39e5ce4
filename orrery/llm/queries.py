"""The training-data queries and their SQL, by registered name."""

from __future__ import annotations

from orrery.llm import cross_tokens, decontaminate, fill_middle, language, line_dedup, mixing, near_dedup, nearest, pii, quality, secrets, substring_dedup, suffix_dedup

QUERIES = {
    "op1_source_mixing": mixing.op1,
    "op2_nearest_neighbours": nearest.op2,
    "op3_secret_scan": secrets.op3,
    "op4_quality_classifier": quality.op4,
    "op5_near_dedup": near_dedup.op5,
    "op6_substring_dedup": substring_dedup.op6,
    "op7_suffix_dedup": suffix_dedup.op7,
    "op8_decontamination": decontaminate.op8,
    "op9_pii": pii.op9,
    "op10_line_dedup": line_dedup.op10,
    "op11_language_id": language.op11,
    "op12_fill_in_middle": fill_middle.op12,
    "op13_cross_tokenizer_alignment": cross_tokens.op13,
}

#: op2 is approximate; the others without SQL are tested against brute force in tests/llm.  SQL of op5, op6 and op7 lists all shingles and windows.
ORACLE_SQL: dict[str, str] = {
    "op1_source_mixing": mixing.OP1_SQL,
    "op5_near_dedup": near_dedup.OP5_SQL,
    "op6_substring_dedup": substring_dedup.OP6_SQL,
    "op7_suffix_dedup": suffix_dedup.OP7_SQL,
    "op12_fill_in_middle": fill_middle.OP12_SQL,
}
