"""The queries of this subpackage, and SQL for those that SQL can express: not for chained matches, flights and profiles (op2, op4, op6), which tests hold against plain versions."""

from __future__ import annotations

import importlib

MODULES = {
    "op1_suffix_dedup": "op1_suffix_dedup",
    "op2_licences": "op2_licences",
    "op3_private": "op3_private",
    "op4_mixing": "op4_mixing",
    "op5_minhash": "op5_minhash",
    "op6_language": "op6_language",
    "op7_decontamination": "op7_decontaminate",
    "op8_sharding": "op8_sharding",
    "op9_line_dedup": "op9_line_dedup",
    "op10_hamming_topk": "op10_hamming_topk",
}
QUERIES = {name: getattr(importlib.import_module(f"linkloom.llm.{module}"), name) for name, module in MODULES.items()}

from linkloom.llm.oracles import ORACLE_SQL  # noqa: E402, F401
