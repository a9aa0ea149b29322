"""Queries of this subpackage and their SQL."""

from propflow.llm import collocations, exact_dedup, importance, language_id, line_dedup, mixing, order_minhash, quality, simhash, token_counts, token_store, trie_bpe, url_filter

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_bpe": trie_bpe.op2_bpe,
    "op3_quality": quality.op3_quality,
    "op4_mixing": mixing.op4_mixing,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_token_store": token_store.op7_token_store,
    "op8_order_minhash": order_minhash.op8_order_minhash,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_collocations": collocations.op11_collocations,
    "op12_importance": importance.op12_importance,
    "op13_language_id": language_id.op13_language_id,
}

SQL = {
    "op6_url_filter": url_filter.SQL,
    "op9_exact_dedup": exact_dedup.SQL,
    "op10_line_dedup": line_dedup.SQL,
    "op11_collocations": collocations.SQL,
    "op12_importance": importance.SQL,
}
