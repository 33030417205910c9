"""The registered queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from jobloom.llm import decontamination, language_id, mixing, pii, quality_model, quality_rules, simhash, tool_calls, url_filter, warc

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_language_id": language_id.op2_language_id,
    "op3_simhash_dedup": simhash.op3_simhash_dedup,
    "op4_tool_calls": tool_calls.op4_tool_calls,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_decontaminate": decontamination.op6_decontaminate,
    "op7_personal_data": pii.op7_personal_data,
    "op8_warc_transactions": warc.op8_warc_transactions,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_quality_model": quality_model.op10_quality_model,
}

ORACLES = {
    "op1_url_filter": url_filter.ORACLE,
    "op4_tool_calls": tool_calls.ORACLE,
    "op5_mix_sources": mixing.ORACLE.format(docs="documents"),
    "op8_warc_transactions": warc.ORACLE,
    "op9_quality_rules": quality_rules.ORACLE,
}
