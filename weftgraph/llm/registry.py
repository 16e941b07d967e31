"""Queries of this subpackage and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from weftgraph.llm import bpe, decontaminate, importance, ppm, pseudonyms, quality_rules, secrets, simhash, token_files, token_rollups

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op2_token_files": token_files.op2_token_files,
    "op3_ppm": ppm.op3_ppm,
    "op4_token_rollups": token_rollups.op4_token_rollups,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_bpe": bpe.op6_bpe,
    "op7_importance": importance.op7_importance,
    "op8_pseudonyms": pseudonyms.op8_pseudonyms,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_simhash": simhash.op10_simhash,
}

ORACLE_SQL: dict[str, str] = {
    "op4_token_rollups": token_rollups.OP4_SQL,
    "op9_quality_rules": quality_rules.OP9_SQL,
}
