"""The subpackage's queries and their SQL."""

from __future__ import annotations

from veilmark.llm import chat, decontaminate, fim, html_extract, jaccard_join, language_id, merkle, packing, quality_classifier, quality_rules, sharding, token_files, url_filter

QUERIES = {
    "op1_token_files": token_files.op1_token_files,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_jaccard_join": jaccard_join.op3_jaccard_join,
    "op4_quality_classifier": quality_classifier.op4_quality_classifier,
    "op5_html_extract": html_extract.op5_html_extract,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_chat_format": chat.op8_chat_format,
    "op9_packing": packing.op9_packing,
    "op10_sharding": sharding.op10_sharding,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_fill_in_middle": fim.op12_fill_in_middle,
    "op13_language_id": language_id.op13_language_id,
}

ORACLES = {
    "op2_quality_rules": quality_rules.oracle_sql(),
    "op3_jaccard_join": jaccard_join.ORACLE_SQL,
    "op6_decontaminate": decontaminate.ORACLE_SQL,
    "op7_url_filter": url_filter.oracle_sql(),
    "op8_chat_format": chat.ORACLE_SQL,
    "op11_merkle_manifest": merkle.ORACLE_SQL,
    "op12_fill_in_middle": fim.ORACLE_SQL,
}
