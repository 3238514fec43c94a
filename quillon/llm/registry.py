"""Queries of the subpackage and the SQL they are held against."""

from __future__ import annotations

from . import op_chat, op_conversation_trie, op_decontamination, op_fingerprints, op_hard_negatives, op_html_text, op_lm_scoring, op_mixing, op_ngram_join, op_quality, op_tokens, op_toxicity, op_warc

MODULES = [op_ngram_join, op_html_text, op_lm_scoring, op_warc, op_mixing, op_tokens, op_chat, op_quality, op_fingerprints, op_decontamination, op_hard_negatives, op_toxicity, op_conversation_trie]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
