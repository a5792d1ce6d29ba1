"""Queries and SQL of the training-data operators, as `__spark_entry__.py` adds them."""

from __future__ import annotations

import corpus_pipeline

from . import chat, fingerprints, jaccard, lines, merkle, packing, pieces, quality, repair, secrets, simhash, topk, toxicity

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_sentencepiece": pieces.op2_sentencepiece,
    "op3_exact_topk": topk.op3_exact_topk,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_fingerprints": fingerprints.op6_fingerprints,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_line_dedup": lines.op8_line_dedup,
    "op9_simhash": simhash.op9_simhash,
    "op10_quality": quality.op10_quality,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_ngram_jaccard": jaccard.op12_ngram_jaccard,
    "op13_conversation_repair": repair.op13_conversation_repair,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {"op3_exact_topk": topk.OP3_SQL, "op11_merkle_manifest": merkle.OP11_SQL, "op12_ngram_jaccard": jaccard.OP12_SQL, "op13_conversation_repair": repair.OP13_SQL}
