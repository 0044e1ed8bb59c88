"""Queries of this subpackage, and SQL for those that SQL can express."""

from graphloom.llm import ctph, html, kmeans, langid, lexical, media, mixing, packing, simhash, suffix, tokens, toxicity, urlrules

QUERIES = {
    "op1_suffix_dedup": suffix.op1,
    "op2_token_shards": tokens.op2,
    "op3_toxicity": toxicity.op3,
    "op4_language_id": langid.op4,
    "op5_html_extract": html.op5,
    "op6_piecewise_hash": ctph.op6,
    "op7_best_fit_packing": packing.op7,
    "op8_media_columns": media.op8,
    "op9_simhash_bktree": simhash.op9,
    "op10_mix_sources": mixing.op10,
    "op11_url_rules": urlrules.op11,
    "op12_lexical_search": lexical.op12,
    "op13_elkan_clusters": kmeans.op13,
}

SQL = {
    "op10_mix_sources": mixing.OP10_SQL,
    "op12_lexical_search": lexical.OP12_SQL,
    "op13_elkan_clusters": kmeans.OP13_SQL,
}
