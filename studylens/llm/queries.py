"""Registered queries of the corpus operators and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, concat_cut, exact_dedup, fill_in_middle, hard_negatives, katz, license_scan, media, minhash, packing, substring_dedup, token_counts, toxicity

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_media_columns": media.op4_media_columns,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_license_scan": license_scan.op7_license_scan,
    "op8_bpe_codec": bpe.op8_bpe_codec,
    "op9_katz_scores": katz.op9_katz_scores,
    "op10_minhash_near_dedup": minhash.op10_minhash_near_dedup,
    "op11_concat_cut": concat_cut.op11_concat_cut,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_fill_in_middle": fill_in_middle.op13_fill_in_middle,
    "media_page_sequences": media.media_page_sequences,
}

ORACLE_SQL = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
    "op13_fill_in_middle": fill_in_middle.OP13_SQL,
}
