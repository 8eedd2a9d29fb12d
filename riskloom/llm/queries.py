"""Registered queries of the corpus operators; DuckDB text where SQL can say it."""

from __future__ import annotations

import importlib

MODULES = ("op1_line_dedup", "op2_sharding", "op3_quality", "op4_embedding_dedup", "op5_minhash_dedup", "op6_pii",
           "op7_decontamination", "op8_chat", "op9_mixing", "op10_toxicity", "op11_collocations", "op12_packing", "op13_importance")


def queries() -> dict:
    out = {}
    for name in MODULES:
        m = importlib.import_module(f"riskloom.llm.{name}")
        out[name] = getattr(m, name)
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for name in MODULES:
        sql = getattr(importlib.import_module(f"riskloom.llm.{name}"), "SQL", None)
        if sql:
            out[name] = sql
    return out
