"""Queries of the training-data operators and their SQL, for the driver's entry."""

from __future__ import annotations

from . import bitpack, chat, clustering, embeddings, html, jaccard, lexical, licenses, mixing, packing, passages, quality, secret_scan


def queries() -> dict:
    return {
        "op1_quality_rules": quality.op1_quality_rules,
        "op2_chat_formatting": chat.op2_chat_formatting,
        "op3_mixing": mixing.op3_mixing,
        "op4_bit_packing": bitpack.op4_bit_packing,
        "op5_packing": packing.op5_packing,
        "op6_substring_dedup": passages.op6_substring_dedup,
        "op7_embedding_near_dedup": embeddings.op7_embedding_near_dedup,
        "op8_html_extraction": html.op8_html_extraction,
        "op9_ngram_jaccard_join": jaccard.op9_ngram_jaccard_join,
        "op10_license_scan": licenses.op10_license_scan,
        "op11_lexical_search": lexical.op11_lexical_search,
        "op12_secret_scan": secret_scan.op12_secret_scan,
        "op13_centroid_clustering": clustering.op13_centroid_clustering,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality.oracle(),
        "op2_chat_formatting": chat.oracle(),
        "op3_mixing": mixing.oracle(),
        "op11_lexical_search": lexical.oracle(),
        "op12_secret_scan": secret_scan.oracle(),
        "op13_centroid_clustering": clustering.oracle(),
    }
