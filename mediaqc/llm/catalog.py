"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from mediaqc.llm import ann, bpe, exact_dedup, exact_search, lm_score, mixing, near_dedup, pii, prefix_trie, quality, resampling, sharding, substring_dedup


def queries() -> dict:
    return {
        "op1_pii": pii.query,
        "op2_byte_bpe": bpe.query,
        "op3_minhash_near_dedup": near_dedup.query,
        "op4_nearest_neighbours": ann.query,
        "op5_lm_score": lm_score.query,
        "op6_mix_sources": mixing.query,
        "op7_substring_dedup": substring_dedup.query,
        "op8_exact_dedup": exact_dedup.query,
        "op9_shard_documents": sharding.query,
        "op10_quality_classifier": quality.query,
        "op11_exact_search": exact_search.query,
        "op12_prefix_trie": prefix_trie.query,
        "op13_importance_resampling": resampling.query,
    }


def oracle_sql() -> dict[str, str]:
    modules = {"op8_exact_dedup": exact_dedup, "op11_exact_search": exact_search, "op12_prefix_trie": prefix_trie, "op13_importance_resampling": resampling}
    return {name: module.ORACLE for name, module in modules.items()}
