"""All queries of the subpackage, and the SQL that says the same where SQL can."""

from __future__ import annotations

from viewtide.llm import decontaminate, langid, lm, mix, passages, quality, shard, simhash, tokens, urls

QUERIES = {
    "op1_mix_sources": mix.op1_mix_sources,
    "op2_quality": quality.op2_quality,
    "op3_url_filter": urls.op3_url_filter,
    "op4_lm_score": lm.op4_lm_score,
    "op5_repeated_passages": passages.op5_repeated_passages,
    "op6_token_files": tokens.op6_token_files,
    "op7_shard": shard.op7_shard,
    "op8_language_id": langid.op8_language_id,
    "op9_simhash": simhash.op9_simhash,
    "op10_decontaminate": decontaminate.op10_decontaminate,
}
SQL = {
    "op1_mix_sources": mix.SQL,
    "op2_quality": quality.SQL,
    "op3_url_filter": urls.SQL,
    "op10_decontaminate": decontaminate.SQL,
}
