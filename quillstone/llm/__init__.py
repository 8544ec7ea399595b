"""Operators for training-data pipelines, their queries and their SQL. Nothing else in quillstone imports this."""

from __future__ import annotations

from importlib import import_module

#: query name -> module of this subpackage that holds the function of that name and, where SQL can express it, SQL.
MODULES = {
    "op1_mix_sources": "mixing",
    "op2_shard_documents": "sharding",
    "op7_format_chat": "chat",
    "op6_scan_secrets": "secrets",
    "op9_token_blocks": "tokens",
    "op4_decontaminate": "decontaminate",
    "op8_exact_top_k": "topk",
    "op10_near_duplicates": "neardup",
    "op3_toxicity": "toxicity",
    "op5_lm_score": "ppm",
    "op13_merkle_manifest": "manifest",
    "op11_periodic_runs": "runs",
    "op12_ngram_jaccard": "jaccard",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__name__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__name__}.{module}"), "SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
