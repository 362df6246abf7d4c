"""The text operators' queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib

#: name: (module, function, SQL or None)
_MODULES = {
    "op1_ngram_jaccard": "jaccard",
    "op2_language_id": "language",
    "op3_license_scan": "licenses",
    "op4_chat_formatting": "chat",
    "op5_decontamination": "decontamination",
    "op6_quality_rules": "quality_rules",
    "op7_html_extraction": "html_text",
    "op8_quality_classifier": "quality_model",
    "op9_best_fit_packing": "packing",
    "op10_token_ids": "token_files",
    "op11_merkle_manifest": "merkle",
    "op12_first_fit_packing": "first_fit",
    "op13_lexical_search": "lexical",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"framewright.llm.{module}"), name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, module in _MODULES.items():
        if sql := getattr(importlib.import_module(f"framewright.llm.{module}"), "ORACLE_SQL", {}).get(name):
            found[name] = sql
    return found
