"""The training-data operators' queries and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from tidemark.llm.byte_bpe import op9_byte_bpe
from tidemark.llm.lm import op1_lm_scoring
from tidemark.llm.neardup import op7_minhash_near_dedup
from tidemark.llm.packing import op5_best_fit_packing
from tidemark.llm.pii import op2_pii
from tidemark.llm.quality import op4_quality_rules
from tidemark.llm.urls import op10_url_filters, oracle_sql as op10_sql
from tidemark.llm.token_counts import op3_token_counts
from tidemark.llm.topk import ORACLE_SQL as OP6_SQL
from tidemark.llm.topk import op6_exact_topk
from tidemark.llm.toxicity import op8_toxicity

QUERIES = {
    "op3_token_counts": op3_token_counts,
    "op1_lm_scoring": op1_lm_scoring,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op6_exact_topk": op6_exact_topk,
    "op10_url_filters": op10_url_filters,
    "op2_pii": op2_pii,
    "op4_quality_rules": op4_quality_rules,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op8_toxicity": op8_toxicity,
    "op9_byte_bpe": op9_byte_bpe,
}

ORACLE_SQL: dict[str, str] = {"op6_exact_topk": OP6_SQL, "op10_url_filters": op10_sql()}
