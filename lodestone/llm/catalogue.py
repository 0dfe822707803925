"""The training-data queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

MODULES = ["op1_warc", "op2_line_crf", "op3_near_dedup", "op4_token_output", "op5_mixing", "op6_licences", "op7_quality", "op8_hnsw", "op9_packing", "op10_toxicity"]


def queries() -> dict:
    return {name: getattr(import_module(f"lodestone.llm.{name}"), name) for name in MODULES}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"lodestone.llm.{name}"), "ORACLE_SQL", None) for name in MODULES}
    return {name: sql for name, sql in found.items() if sql}
