"""Registered queries of this package: operators applied to their whole tables."""

from __future__ import annotations

from docketry.llm import (op1_licenses, op2_language, op3_multi_index, op4_rans, op5_spans, op6_pii, op7_packing, op8_simhash, op9_range_join,
                          op10_mixing, op11_prefix_trie, op12_spelling, op13_chat)

QUERIES = {f.__name__: f for f in (
    op1_licenses.op1_license_scan, op2_language.op2_language_profiles, op3_multi_index.op3_multi_index, op4_rans.op4_rans_tokens,
    op5_spans.op5_sentence_spans, op6_pii.op6_pii_field, op7_packing.op7_best_fit_packing, op8_simhash.op8_simhash,
    op9_range_join.op9_embedding_range_join, op10_mixing.op10_entropy_mixing, op11_prefix_trie.op11_prefix_trie,
    op12_spelling.op12_permuterm_variants, op13_chat.op13_reply_trees)}
SQL: dict[str, str] = {"op11_prefix_trie": op11_prefix_trie.SQL, "op12_permuterm_variants": op12_spelling.SQL, "op13_reply_trees": op13_chat.SQL}
