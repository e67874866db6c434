"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from commitlens.llm import (
    chat, conversation_repair, decontaminate, embedding_dedup, html_text, jaccard_join, licenses, prefix_trie, quality, secrets,
    sentencepiece, token_counts, warc,
)

QUERIES = {
    "op1_sentencepiece": sentencepiece.op1_sentencepiece,
    "op2_chat_format": chat.op2_chat_format,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_warc": warc.op5_warc,
    "op6_html_text": html_text.op6_html_text,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_secret_scan": secrets.op9_secret_scan,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_embedding_dedup": embedding_dedup.op13_embedding_dedup,
}

SQL = {
    "op3_decontaminate": decontaminate.OP3_SQL,
    "op5_warc": warc.OP5_SQL,
    "op11_prefix_trie": prefix_trie.OP11_SQL,
    "op12_conversation_repair": conversation_repair.OP12_SQL,
    "op13_embedding_dedup": embedding_dedup.OP13_SQL,
}
