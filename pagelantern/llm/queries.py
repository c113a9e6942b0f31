"""The queries and SQL that this subpackage adds to __spark_entry__.py."""

from __future__ import annotations

from pagelantern.llm import bpe, chat, embedding_dedup, fingerprints, hard_negatives, html_text, language_id, licenses, mixing, prefix_trie, quality_mil, secret_scan, simhash

QUERIES = {
    "op1_embedding_dedup": embedding_dedup.op1_embedding_dedup,
    "op2_poisson_mix": mixing.op2_poisson_mix,
    "op3_simhash": simhash.op3_simhash,
    "op4_bpe": bpe.op4_bpe,
    "op5_fingerprints": fingerprints.op5_fingerprints,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_html_text": html_text.op7_html_text,
    "op8_secret_scan": secret_scan.op8_secret_scan,
    "op9_language_id": language_id.op9_language_id,
    "op10_chat": chat.op10_chat,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_quality": quality_mil.op12_quality,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

SQL: dict[str, str] = {
    "op2_poisson_mix": mixing.SQL,
    "op10_chat": chat.SQL,
    "op11_prefix_trie": prefix_trie.SQL,
    "op13_hard_negatives": hard_negatives.SQL,
}
