"""The queries of this folder and their SQL texts."""

from __future__ import annotations

from cairn.llm import bpe, conversations, decontaminate, divergence, exact_dedup, katz, licenses, line_dedup, ngram_join, pii, quality, token_counts, token_files

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_quality": quality.op2_quality,
    "op3_token_files": token_files.op3_token_files,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_bpe": bpe.op5_bpe,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_katz": katz.op7_katz,
    "op8_licenses": licenses.op8_licenses,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_divergence": divergence.op11_divergence,
    "op12_conversations": conversations.op12_conversations,
    "op13_pii": pii.op13_pii,
}

ORACLES = {
    "op4_line_dedup": line_dedup.OP4_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
    "op11_divergence": divergence.OP11_SQL,
    "op12_conversations": conversations.OP12_SQL,
}
