"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from readloom.llm import bpe, chat, flac, mixing, ngram_join, pii, pitman_yor, quality_rules, ranking, resampling, secrets_scan, turns, wavelet

QUERIES = {
    "op1_semi_markov_crf": pii.op1_semi_markov_crf,
    "op2_distribution_divergence": quality_rules.op2_distribution_divergence,
    "op3_pitman_yor": pitman_yor.op3_pitman_yor,
    "op4_prefix_target": chat.op4_prefix_target,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_ngram_jaccard": ngram_join.op6_ngram_jaccard,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_secret_scan": secrets_scan.op8_secret_scan,
    "op9_bradley_terry": ranking.op9_bradley_terry,
    "op10_flac": flac.op10_flac,
    "op11_importance_resampling": resampling.op11_importance_resampling,
    "op12_wavelet_shards": wavelet.op12_wavelet_shards,
    "op13_retained_turns": turns.op13_retained_turns,
}
SQL = {"op4_prefix_target": chat.SQL, "op6_ngram_jaccard": ngram_join.SQL, "op7_mix_sources": mixing.SQL, "op11_importance_resampling": resampling.SQL, "op13_retained_turns": turns.SQL}
