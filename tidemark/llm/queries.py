"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from importlib import import_module

#: Query name to module of this subpackage (the function has the query's name).
_MODULES = {
    "op1_exact_topk": "topk",
    "op2_warc": "warc",
    "op3_chat_formatting": "chat",
    "op4_best_fit_packing": "packing",
    "op5_source_mixing": "mixing",
    "op6_media_columns": "media",
    "op7_minhash_dedup": "dedup",
    "op8_license_scans": "licenses",
    "op9_quality_classifier": "quality",
    "op10_sharding": "sharding",
    "op11_html_extraction": "extract",
    "op12_conversation_trie": "trie",
    "op13_vector_codes": "codes",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in dict.fromkeys(_MODULES.values()):
        out |= getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", {})
    return out
