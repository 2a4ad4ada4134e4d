"""The registered queries of this subpackage."""

from __future__ import annotations

from lithos.llm import op1_sharding, op2_licences, op3_repair, op4_lines, op5_mixing, op6_minhash, op7_warc
from lithos.llm import op8_quality, op9_decontaminate, op10_toxicity, op11_substrings, op12_merkle, op13_alignment

MODULES = {
    "op1_sharding": op1_sharding,
    "op2_licences": op2_licences,
    "op3_repair": op3_repair,
    "op4_lines": op4_lines,
    "op5_mixing": op5_mixing,
    "op6_minhash": op6_minhash,
    "op7_warc": op7_warc,
    "op8_quality": op8_quality,
    "op9_decontaminate": op9_decontaminate,
    "op10_toxicity": op10_toxicity,
    "op11_substrings": op11_substrings,
    "op12_merkle": op12_merkle,
    "op13_alignment": op13_alignment,
}


def queries() -> dict:
    return {name: module.query for name, module in MODULES.items()}


def oracle_sql() -> dict:
    return {name: module.SQL for name, module in MODULES.items() if hasattr(module, "SQL")}
