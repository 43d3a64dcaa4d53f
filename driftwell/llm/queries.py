"""The registered queries of this folder and the SQL that must agree with them."""

from driftwell.llm import exact_dedup, hard_negatives, language, line_dedup, mixing, prefix_trie, pseudonyms, quality, simhash, token_files, toxicity, url_filter, word_bpe

QUERIES = {
    "op2_pseudonyms": pseudonyms.op2_pseudonyms,
    "op4_quality": quality.op4_quality,
    "op5_word_bpe": word_bpe.op5_word_bpe,
    "op1_token_files": token_files.op1_token_files,
    "op3_simhash": simhash.op3_simhash,
    "op6_url_filter": url_filter.op6_url_filter,
    "op9_language_id": language.op9_language_id,
    "op10_toxicity": toxicity.op10_toxicity,
    "op7_mixing": mixing.op7_mixing,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op11_line_dedup": line_dedup.op11_line_dedup,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLES = {
    "op6_url_filter": url_filter.SQL,
    "op7_mixing": mixing.SQL,
    "op8_exact_dedup": exact_dedup.SQL,
    "op11_line_dedup": line_dedup.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
    "op13_prefix_trie": prefix_trie.SQL,
}
