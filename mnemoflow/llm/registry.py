"""Queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, codes, hmm, minhash, mixing, private, quality, repeats, rollups

QUERIES = {
    "op2_quality_rules": quality.quality_rules,
    "op4_minhash_near_dedup": minhash.minhash_near_dedup,
    "op6_byte_bpe": bpe.byte_bpe,
    "op7_mixing_curriculum": mixing.mixing_curriculum,
    "op9_suffix_repeats": repeats.suffix_repeats,
    "op5_personal_data": private.personal_data,
    "op1_hmm_scores": hmm.hmm_scores,
    "op8_token_counts": rollups.token_counts,
    "op10_one_bit_neighbours": codes.one_bit_neighbours,
    "op3_quality_classifier": quality.quality_classifier,
}
ORACLE_SQL = {"op4_minhash_near_dedup": minhash.ORACLE, "op9_suffix_repeats": repeats.ORACLE, "op10_one_bit_neighbours": codes.ORACLE}
