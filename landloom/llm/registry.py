"""Queries of the training-data operators, for ``__spark_entry__.py``."""

from __future__ import annotations

from . import ann, bpe, chat, filter_audit, langid, line_dedup, mixing, prefix_trie, quality, simhash, toxicity, vector_dedup, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_nearest_neighbours": ann.op2_nearest_neighbours,
    "op3_chat_format": chat.op3_chat_format,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_language_id": langid.op5_language_id,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_bpe": bpe.op7_bpe,
    "op8_mixing": mixing.op8_mixing,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_simhash": simhash.op10_simhash,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_vector_dedup": vector_dedup.op13_vector_dedup,
}

#: Only results that SQL expresses over whole tables; the tests hold the others against brute force.
ORACLES = {
    "op1_warc": warc.ORACLE,
    "op3_chat_format": chat.ORACLE,
    "op9_line_dedup": line_dedup.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
    "op13_vector_dedup": vector_dedup.ORACLE,
}
