"""Operators that prepare training data for language models, each with a registered query."""

from varlex.llm import alignment, best_fit, bpe_replay, decontaminate, language_id, line_dedup, quality, repair_output, sharding, simhash_trie, spelling, token_counts, toxicity

QUERIES = {
    "op1_noisy_or": toxicity.op1_noisy_or,
    "op2_rendezvous": sharding.op2_rendezvous,
    "op3_re_pair": repair_output.op3_re_pair,
    "op4_bpe_replay": bpe_replay.op4_bpe_replay,
    "op5_kneser_ney": language_id.op5_kneser_ney,
    "op6_fuzzy_lines": line_dedup.op6_fuzzy_lines,
    "op7_adaptive_quality": quality.op7_adaptive_quality,
    "op8_whole_tokens": token_counts.op8_whole_tokens,
    "op9_simhash_trie": simhash_trie.op9_simhash_trie,
    "op10_qgram_bands": decontaminate.op10_qgram_bands,
    "op11_trie_pairs": spelling.op11_trie_pairs,
    "op12_best_fit": best_fit.op12_best_fit,
    "op13_merge_path": alignment.op13_merge_path,
}

SQL = {"op7_adaptive_quality": quality.OP7_SQL}
