"""The queries and the SQL of this subpackage's operators."""

from __future__ import annotations

from . import decontamination, licenses, middles, mixing, ngrams, private, quality, simhash, substrings, suffixes, tokens, tries, urls

QUERIES = {
    "op1_source_mix": mixing.op1_source_mix,
    "op2_repetition_rules": quality.op2_repetition_rules,
    "op3_simhash_dedup": simhash.op3_simhash_dedup,
    "op4_substring_dedup": substrings.op4_substring_dedup,
    "op5_url_filter": urls.op5_url_filter,
    "op6_token_files": tokens.op6_token_files,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_suffix_dedup": suffixes.op8_suffix_dedup,
    "op9_personal_data": private.op9_personal_data,
    "op10_decontaminate": decontamination.op10_decontaminate,
    "op11_lm_scores": ngrams.op11_lm_scores,
    "op12_fill_in_middle": middles.op12_fill_in_middle,
    "op13_conversation_trie": tries.op13_conversation_trie,
}

#: Operators 3, 5 to 9 and 11 can't be expressed in SQL, or not over whole tables; tests hold them against brute force.
ORACLES = {
    "op1_source_mix": mixing.OP1_SQL,
    "op2_repetition_rules": quality.OP2_SQL,
    "op4_substring_dedup": substrings.OP4_SQL,
    "op10_decontaminate": decontamination.OP10_SQL,
    "op12_fill_in_middle": middles.OP12_SQL,
    "op13_conversation_trie": tries.OP13_SQL,
}
