"""Registered queries of the training-data operators, and their SQL for DuckDB."""

from __future__ import annotations

from ledgerloom.llm import byte_bpe, jaccard_join, license_scan, line_dedup, media_columns, packing, pii, quality_lm, topk_search, toxicity

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_media_columns": media_columns.op2_media_columns,
    "op3_byte_bpe": byte_bpe.op3_byte_bpe,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_packing": packing.op6_packing,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_pii": pii.op8_pii,
    "op9_topk_search": topk_search.op9_topk_search,
    "op10_quality_lm": quality_lm.op10_quality_lm,
}

ORACLE_SQL = {
    "op1_license_scan": license_scan.oracle(),
    "op5_line_dedup": line_dedup.oracle(),
    "op7_jaccard_join": jaccard_join.ORACLE,
    "op9_topk_search": topk_search.ORACLE,
}
