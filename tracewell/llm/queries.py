"""The queries of this subpackage and the SQL that some of them can be held against."""

from __future__ import annotations

from tracewell.llm import bpe, decontaminate, language_id, quality_rules, secret_scan, similarity_join, suffix_dedup, token_codes, toxicity, warc


def queries() -> dict:
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_bpe": bpe.op2_bpe,
        "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
        "op4_token_codes": token_codes.op4_token_codes,
        "op5_warc": warc.op5_warc,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_secret_scan": secret_scan.op8_secret_scan,
        "op9_similarity_join": similarity_join.op9_similarity_join,
        "op10_language_id": language_id.op10_language_id,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality_rules.ORACLE, "op5_warc": warc.ORACLE, "op7_decontaminate": decontaminate.ORACLE, "op9_similarity_join": similarity_join.ORACLE}
