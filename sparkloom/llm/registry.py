"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib

#: Query name and module; a module has query(spark, sf_dir) and may have ORACLE_SQL.
OPERATORS = {
    "op4_compression_bands": "op4_compression",
    "op5_toxicity": "op5_toxicity",
    "op6_decontaminate": "op6_decontaminate",
    "op7_language_id": "op7_language",
    "op1_suffix_array": "op1_suffixes",
    "op2_license_scan": "op2_licenses",
    "op3_ngram_jaccard": "op3_jaccard",
    "op8_range_coder": "op8_range_coder",
    "op9_sentencepiece": "op9_sentencepiece",
    "op10_line_dedup": "op10_lines",
}


def queries() -> dict:
    return {name: importlib.import_module(f"sparkloom.llm.{module}").query for name, module in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"sparkloom.llm.{module}"), "ORACLE_SQL", None) for name, module in OPERATORS.items()}
    return {name: sql for name, sql in found.items() if sql}
