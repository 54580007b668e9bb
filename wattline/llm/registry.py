"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from wattline.llm import decontam, langid, mixing, neardup, quality, recompress, sql, suffixes, tokens, urls, warc


def queries() -> dict:
    return {
        "op1_recompression_dedup": recompress.op1,
        "op2_suffix_array_dedup": suffixes.op2,
        "op3_warc_derivatives": warc.op3,
        "op4_minhash_neardup": neardup.op4,
        "op5_language_id": langid.op5,
        "op6_token_wavelet": tokens.op6,
        "op7_mix_sources": mixing.op7,
        "op8_decontaminate": decontam.op8,
        "op9_quality_cascade": quality.op9,
        "op10_url_rules": urls.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_recompression_dedup": sql.OP1,
        "op2_suffix_array_dedup": sql.OP2,
        "op4_minhash_neardup": sql.OP4,
        "op7_mix_sources": sql.op7(),
        "op9_quality_cascade": sql.op9(),
        "op10_url_rules": urls.op10_sql(),
    }
