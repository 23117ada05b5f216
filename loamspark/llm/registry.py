"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import op1_licences, op2_toxicity, op3_mixing, op4_jaccard, op5_packing, op6_pitman_yor, op7_media, op8_sharding, op9_ann, op10_token_files, op11_suffix_dedup, op12_prefix_trie, op13_importance

QUERIES = {
    "op1_licences": op1_licences.op1_licences,
    "op2_toxicity": op2_toxicity.op2_toxicity,
    "op3_mixing": op3_mixing.op3_mixing,
    "op4_jaccard": op4_jaccard.op4_jaccard,
    "op5_packing": op5_packing.op5_packing,
    "op6_pitman_yor": op6_pitman_yor.op6_pitman_yor,
    "op7_media": op7_media.op7_media,
    "op8_sharding": op8_sharding.op8_sharding,
    "op9_ann": op9_ann.op9_ann,
    "op10_token_files": op10_token_files.op10_token_files,
    "op11_suffix_dedup": op11_suffix_dedup.op11_suffix_dedup,
    "op12_prefix_trie": op12_prefix_trie.op12_prefix_trie,
    "op13_importance": op13_importance.op13_importance,
}

SQL = {
    "op1_licences": op1_licences.SQL,
    "op3_mixing": op3_mixing.SQL,
    "op12_prefix_trie": op12_prefix_trie.SQL,
}
