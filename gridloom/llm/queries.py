"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import exact_dedup, html_text, jaccard_join, lm_scoring, mixing, packing, sharding, token_files, topk, toxicity

QUERIES = {
    "op1_topk": topk.topk_query,
    "op2_jaccard": jaccard_join.jaccard_query,
    "op3_html": html_text.html_query,
    "op4_mixing": mixing.mixing_query,
    "op5_exact_dedup": exact_dedup.exact_dedup_query,
    "op6_lm_scoring": lm_scoring.lm_query,
    "op7_packing": packing.packing_query,
    "op8_token_files": token_files.token_files_query,
    "op10_toxicity": toxicity.toxicity_query,
    "op9_sharding": sharding.sharding_query,
}
ORACLES = {"op1_topk": topk.ORACLE, "op4_mixing": mixing.ORACLE, "op5_exact_dedup": exact_dedup.ORACLE}
