"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import embedding_dedup, exact_topk, jaccard_join, language_id, mixing, packing, sharding, substring_dedup, suffix_dedup, toxicity

QUERIES = {
    "op1_embedding_dedup": embedding_dedup.op1_embedding_dedup,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_source_mixing": mixing.op3_source_mixing,
    "op4_language_id": language_id.op4_language_id,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_jaccard_join": jaccard_join.op6_jaccard_join,
    "op7_sharding": sharding.op7_sharding,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_exact_topk": exact_topk.op10_exact_topk,
}
ORACLE_SQL = {
    "op2_substring_dedup": substring_dedup.SQL,
    "op3_source_mixing": mixing.SQL,
    "op5_suffix_dedup": suffix_dedup.SQL,
    "op6_jaccard_join": jaccard_join.SQL,
    "op10_exact_topk": exact_topk.SQL,
}
