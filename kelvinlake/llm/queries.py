"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from kelvinlake.llm import bpe, conversation_repair, embedding_dedup, fingerprint, line_dedup, lm_score, near_dedup, packing, quality, secret_scan, token_alignment, toxicity, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_secret_scan": secret_scan.op4_secret_scan,
    "op5_lm_score": lm_score.op5_lm_score,
    "op6_embedding_dedup": embedding_dedup.op6_embedding_dedup,
    "op7_quality": quality.op7_quality,
    "op8_bpe": bpe.op8_bpe,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_packing": packing.op10_packing,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_token_alignment": token_alignment.op12_token_alignment,
    "op13_fingerprint": fingerprint.op13_fingerprint,
    "pipeline": corpus_pipeline.run,
    # those columns of three operators that SQL can express
    "fingerprint_edits": fingerprint.fingerprint_edits,
    "url_rules": url_filter.url_rules,
    "quality_counts": quality.quality_counts,
}

ORACLES = {
    "op2_near_dedup": near_dedup.op2_sql(),
    "op3_line_dedup": line_dedup.OP3_SQL,
    "op6_embedding_dedup": embedding_dedup.OP6_SQL,
    "fingerprint_edits": fingerprint.EDITS_SQL,
    "url_rules": url_filter.URL_RULES_SQL,
    "quality_counts": quality.QUALITY_COUNTS_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
