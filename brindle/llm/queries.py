"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from brindle.llm import ann, chat, langid, lexical, mixing, periodic, quality, secretscan, sentencepieces, simhash, substring, tokencounts, toxicity

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_language_id": langid.op3_language_id,
    "op4_chat": chat.op4_chat,
    "op5_sentencepiece": sentencepieces.op5_sentencepiece,
    "op6_substring_dedup": substring.op6_substring_dedup,
    "op7_ann": ann.op7_ann,
    "op8_simhash": simhash.op8_simhash,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_token_counts": tokencounts.op10_token_counts,
    "op11_lexical_search": lexical.op11_lexical_search,
    "op12_periodic_runs": periodic.op12_periodic_runs,
    "op13_secret_scan": secretscan.op13_secret_scan,
}
ORACLES = {"op4_chat": chat.ORACLE_SQL, "op9_quality_rules": quality.ORACLE_SQL, "op11_lexical_search": lexical.ORACLE_SQL, "op12_periodic_runs": periodic.ORACLE_SQL}
